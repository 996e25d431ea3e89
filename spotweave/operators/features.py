"""Feature blocks of a cell put side by side: latent position, soft labels, place and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.stats import softmax
from spotweave.operators.knn import knn_plane, knn_vectors, local_density
from spotweave.session import checkpoint


def standardised(df: DataFrame, by: list[str], id_: str, v: str) -> DataFrame:
    """df with each component of the vector ``v`` less its dataset's mean, over its population deviation; a deviation of 0 counts as 1.

    Means come from one aggregate per component and travel as one row for each dataset.
    """
    x = df.select(*by, F.posexplode(v).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    m = x.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0).alias("s")))), lambda t: F.struct(t["m"], t["s"])).alias("__m"))
    return df.join(m, by).withColumn(v, F.zip_with(v, "__m", lambda a, t: (a - t["m"]) / t["s"])).drop("__m")


def scaled(v: Column, weight: float) -> Column:
    return F.transform(v, lambda x: x * weight)


def combined_features(points: DataFrame, by: list[str], id_: str, v: str, x: str, y: str, k: int = 15, place_weight: float = 1.0) -> DataFrame:
    """(by, id_, features): the blocks 1.5 * latent, 0.8 * soft labels, 0.35 * place and 0.25 * density, standardised again.

    Soft labels are the sharpened softmax (power 1.5) of the latent vector; density is that of the ``k`` nearest in latent space, self included. ``place_weight`` scales the last two blocks.
    No random jitter is added. Points without a vector or a place are left out.
    """
    p = points.select(*by, id_, F.col(v).cast("array<double>").alias("v"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("xy")).filter("v is not null and not exists(xy, c -> c is null or isnan(c))")
    p = checkpoint(p)
    wide = p.select(F.max(F.size("v"))).first()[0] or 0
    if wide == 2:
        near = knn_plane(p.select(*by, id_, F.col("v")[0].alias("a"), F.col("v")[1].alias("b")), by, id_, "a", "b", k, include_self=True)
    else:
        near = knn_vectors(p, p, id_, "v", k - 1, by=by)
        near = near.unionByName(p.select(*by, F.col(id_).alias("src"), F.col(id_).alias("dst"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("dist")))
    density = local_density(near, by).select(*by, F.col("src").alias(id_), "density")
    t = checkpoint(p.join(density, [*by, id_])).withColumn("soft", softmax(F.col("v"), 1.5))
    t = standardised(standardised(t, by, id_, "v"), by, id_, "xy")
    t = t.select(*by, id_, F.concat(scaled(F.col("v"), 1.5), scaled(F.col("soft"), 0.8), scaled(F.col("xy"), 0.35 * place_weight), F.array(F.col("density") * 0.25 * place_weight)).alias("features"))
    return standardised(t, by, id_, "features")
