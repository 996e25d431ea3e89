"""The tables that the reference's own operators run on, and their SQL.

Molecules are the latest states that lie in a listed cell; a run is a dataset; a cell's label is its smallest non-null
``cluster`` other than ``noise``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions.keys import name_key, present
from spotweave.operators.latest import latest_rows
from spotweave.operators.matrix import count_matrix
from spotweave.session import table

RUN = ["run_id"]


def molecules(spark: SparkSession, d: str) -> DataFrame:
    t = latest_rows(table(spark, d, "transcripts"), ["transcript_id"], "loaded_at", ["run_id", "x_location", "y_location", "cell_id", "feature_name", "qv"])
    t = t.withColumn("gene", name_key("feature_name")).filter(present("x_location") & present("y_location") & F.col("gene").isNotNull() & (F.col("gene") != ""))
    listed = table(spark, d, "cells").select("run_id", "cell_id").distinct()
    return t.join(listed, ["run_id", "cell_id"], "left_semi").select("transcript_id", "run_id", F.col("x_location").alias("x"), F.col("y_location").alias("y"), "cell_id", "gene")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return count_matrix(molecules(spark, d), RUN, "cell_id", "gene")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "umap_clusters_final").filter("cluster is not null and cluster <> 'noise'").groupBy("run_id", "cell_id").agg(F.min("cluster").alias("cluster"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cells").groupBy("run_id", "cell_id").agg(F.min(F.struct("x_centroid_px", "y_centroid_px")).alias("p"), F.max("area_px").alias("area"))
    return c.select("run_id", "cell_id", F.col("p.x_centroid_px").alias("x"), F.col("p.y_centroid_px").alias("y"), "area").filter("x is not null and y is not null")


def plane(spark: SparkSession, d: str) -> DataFrame:
    """Layout points: (run_id, cell_id, x, y) with both coordinates."""
    u = table(spark, d, "umap_clusters_final").filter(present("umap1") & present("umap2"))
    return u.groupBy("run_id", "cell_id").agg(F.min(F.struct("umap1", "umap2")).alias("p")).select("run_id", "cell_id", F.col("p.umap1").cast("double").alias("x"), F.col("p.umap2").cast("double").alias("y"))


MOL = """
with l as (select transcript_id, arg_max(struct_pack(run_id := run_id, x := x_location, y := y_location, cell_id := cell_id, f := feature_name),
             struct_pack(t := loaded_at, a := run_id, b := coalesce(x_location, '-infinity'::double), c := coalesce(y_location, '-infinity'::double), e := coalesce(cell_id, ''), f := coalesce(feature_name, ''))) as s
           from transcripts group by 1),
mol as (select transcript_id, s.run_id as run_id, s.x as x, s.y as y, s.cell_id as cell_id, upper(trim(s.f)) as gene from l
        where s.x is not null and s.y is not null and not isnan(s.x) and not isnan(s.y) and trim(s.f) <> ''
          and exists (select 1 from cells c where c.run_id = s.run_id and c.cell_id = s.cell_id))
"""
CNT = MOL + ", cnt as (select run_id, cell_id, gene, count(*) as n from mol group by all)\n"
LAB = "lab as (select run_id, cell_id, min(cluster) as cluster from umap_clusters_final where cluster is not null and cluster <> 'noise' group by all)\n"
XY = "xy as (select run_id, cell_id, min({'x': x_centroid_px, 'y': y_centroid_px}).x as x, min({'x': x_centroid_px, 'y': y_centroid_px}).y as y, max(area_px) as area from cells where x_centroid_px is not null and y_centroid_px is not null group by all)\n"
PLANE = "pl as (select run_id, cell_id, min({'x': umap1, 'y': umap2}).x::double as x, min({'x': umap1, 'y': umap2}).y::double as y from umap_clusters_final where umap1 is not null and umap2 is not null and not isnan(umap1) and not isnan(umap2) group by all)\n"
NORM = CNT + ", nrm as (select *, ln(1 + n / (sum(n) over (partition by run_id, cell_id))::double * 1e4) as x from cnt)\n"


def tail_sql(z: str) -> str:
    """SQL of the two-sided normal tail beyond ``z``, to about 1e-13: one minus the series erf(x) = exp(-x^2) sum x^(2n+1) / gamma(n + 3/2)."""
    x = f"least(greatest(abs({z}) / sqrt(2::double), 1e-300), 6.0)"
    return f"greatest(0, 1 - list_sum(list_transform(range(0, 150), lambda k: exp(-{x} * {x} + (2 * k + 1) * ln({x}) - lgamma(k + 1.5)))))"
