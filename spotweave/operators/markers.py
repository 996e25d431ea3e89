"""Marker genes of clusters, from sparse counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.functions.stats import log2_fold, neg_log10, specificity
from spotweave.operators.skew import running_sum
from spotweave.session import checkpoint


def in_out(values: DataFrame, labels: DataFrame, by: list[str], cell: str, gene: str, x: str) -> DataFrame:
    """(by, cluster, gene, n_in, n_all, sum_in, sum_all, nz_in, nz_all) for every cluster and gene of a dataset.

    One pass: sums per (cluster, gene) and per gene; the outside is the difference, so there is no loop over clusters. Cells without a label
    belong to no cluster and are left out altogether. ``labels`` has (by, cell, cluster), one row for each cell.
    """
    v = values.select(*by, cell, gene, F.col(x).alias("x")).join(labels.select(*by, cell, "cluster"), [*by, cell])
    inside = v.groupBy(*by, "cluster", gene).agg(F.sum("x").alias("sum_in"), F.count(F.lit(1)).alias("nz_in"))
    whole = inside.groupBy(*by, gene).agg(F.sum("sum_in").alias("sum_all"), F.sum("nz_in").alias("nz_all"))
    cells = values.select(*by, cell).distinct().join(labels.select(*by, cell, "cluster"), [*by, cell])
    sizes = cells.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n_in"))
    sizes = sizes.withColumn("n_all", F.sum("n_in").over(Window.partitionBy(*by)))
    pairs = sizes.join(whole, by)
    out = pairs.join(inside, [*by, "cluster", gene], "left")
    return out.select(*by, "cluster", gene, "n_in", "n_all", F.coalesce("sum_in", F.lit(0.0)).alias("sum_in"), "sum_all", F.coalesce("nz_in", F.lit(0)).alias("nz_in"), "nz_all")


def contrasts(values: DataFrame, labels: DataFrame, by: list[str], cell: str, gene: str, x: str) -> DataFrame:
    """in_out with mean_in, mean_out, pct_in, pct_out, and contrast = mean_in - mean_out; null outside means where nothing is outside."""
    t = in_out(values, labels, by, cell, gene, x)
    n_out = F.nullif(F.col("n_all") - F.col("n_in"), F.lit(0))
    t = t.withColumn("mean_in", F.col("sum_in") / F.col("n_in")).withColumn("mean_out", (F.col("sum_all") - F.col("sum_in")) / n_out)
    t = t.withColumn("pct_in", F.col("nz_in") / F.col("n_in")).withColumn("pct_out", (F.col("nz_all") - F.col("nz_in")) / n_out)
    return t.withColumn("contrast", F.col("mean_in") - F.col("mean_out"))


def fast_markers(values: DataFrame, labels: DataFrame, by: list[str], cell: str, gene: str, x: str, n: int = 10, min_cells: int = 10) -> DataFrame:
    """The ``n`` best genes of each cluster by specificity: (by, cluster, rank, gene, log2fc, mean_in, mean_out, pct_in, pct_out, score, n_cells_in).

    Genes must be detected in a tenth of the cluster, no less often than outside, and be raised; where no gene passes, raised ones count, and
    where there is none, all do. A cluster under ``min_cells`` cells gives one placeholder row ``(cluster too small)``. Ties go to the smaller name.
    """
    t = contrasts(values, labels, by, cell, gene, x)
    small = t.filter(F.col("n_in") < min_cells).select(*by, "cluster", "n_in").distinct()
    fold = log2_fold(F.col("mean_in"), F.col("mean_out"))
    t = t.filter(F.col("n_in") >= min_cells).filter("mean_out is not null").withColumn("log2fc", F.round(fold, 9))
    t = t.withColumn("score", specificity(fold, F.col("pct_in"), F.col("pct_out")))
    gate = F.when((F.col("pct_in") >= 0.1) & (F.col("pct_in") >= F.col("pct_out")) & (F.col("log2fc") > 0), 2).when(F.col("log2fc") > 0, 1).otherwise(0)
    w = Window.partitionBy(*by, "cluster")
    t = t.withColumn("gate", gate).withColumn("best", F.max("gate").over(w)).filter("gate = best")
    t = t.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), gene)).cast("long")).filter(F.col("rank") <= n)
    kept = t.select(*by, "cluster", "rank", gene, "log2fc", "mean_in", "mean_out", "pct_in", "pct_out", "score", F.col("n_in").alias("n_cells_in"))
    none = F.lit(None).cast("double")
    return kept.unionByName(small.select(*by, "cluster", F.lit(1).cast("long").alias("rank"), F.lit("(cluster too small)").alias(gene), *[none.alias(c) for c in ("log2fc", "mean_in", "mean_out", "pct_in", "pct_out", "score")], F.col("n_in").alias("n_cells_in")))


def adjust_bh(df: DataFrame, by: list[str], p: str, out: str, key: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p within each group: the least p * m / rank over this and larger ranks, at most 1."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.col(p), key))
    d = df.withColumn("__rn", rank).withColumn("__m", F.count(F.lit(1)).over(w))
    low = F.min(F.col(p) * F.col("__m") / F.col("__rn")).over(w.orderBy(F.col("__rn").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, F.least(low, F.lit(1.0))).drop("__rn", "__m")


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail probability."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")


def rank_sum_scores(values: DataFrame, labels: DataFrame, by: list[str], cell: str, gene: str, x: str, min_cells: int = 5) -> DataFrame:
    """Wilcoxon rank-sum z (normal approximation, no tie correction) and log fold change: (by, cluster, gene, score, logfoldchange).

    Zeros are the smallest values and share one rank; only non-zeros are ranked, per gene, with ties averaged. Clusters under ``min_cells`` cells are left out
    together with their cells, as are cells without a label.
    """
    size = values.select(*by, cell).distinct().join(labels.select(*by, cell, "cluster"), [*by, cell])
    large = size.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_cells)
    size = size.join(large.select(*by, "cluster"), [*by, "cluster"], "left_semi")
    v = values.select(*by, cell, gene, F.col(x).alias("x")).join(size.select(*by, cell, "cluster"), [*by, cell])
    # Equal values of a gene are counted by cluster; ranks of the distinct values come from running sums over range partitions, so no task holds a gene.
    c = checkpoint(v.groupBy(*by, gene, F.round("x", 9).alias("__x"), "cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("s")))
    ranks = running_sum(c.groupBy(*by, gene, "__x").agg(F.sum("c").alias("m")), [*by, gene], ["__x"], "m", "__up")
    ranks = ranks.select(*by, gene, "__x", (F.col("__up") - (F.col("m") - 1) / 2.0).alias("r"))
    t = c.join(ranks, [*by, gene, "__x"]).groupBy(*by, "cluster", gene).agg(F.sum(F.col("r") * F.col("c")).alias("r"), F.sum("c").alias("p"), F.sum("s").alias("s"))
    whole = t.groupBy(*by, gene).agg(F.sum("p").alias("p_all"), F.sum("s").alias("s_all"))
    sizes = size.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    a = sizes.join(whole, by).join(t, [*by, "cluster", gene], "left").na.fill(0, ["p"]).na.fill(0.0, ["r", "s"])
    zeros, n, total = F.col("total") - F.col("p_all"), F.col("n"), F.col("total")
    ranks = F.col("r") + F.col("p") * zeros + (n - F.col("p")) * (zeros + 1) / 2.0
    z = (ranks - n * (total + 1) / 2.0) / F.sqrt(n * (total - n) * (total + 1) / 12.0)
    fold = log2_fold(F.col("s") / n, (F.col("s_all") - F.col("s")) / (total - n), 1e-9)
    return a.filter("total > n").select(*by, "cluster", gene, z.alias("score"), fold.alias("logfoldchange"))


def rank_sum_markers(values: DataFrame, labels: DataFrame, by: list[str], cell: str, gene: str, x: str, min_cells: int = 5) -> DataFrame:
    """rank_sum_scores with pval and pval_adj (Benjamini-Hochberg within each cluster)."""
    t = rank_sum_scores(values, labels, by, cell, gene, x, min_cells).withColumn("pval", two_sided_p("score"))
    return adjust_bh(t, [*by, "cluster"], "pval", "pval_adj", gene)


def significant(markers: DataFrame, p: float = 0.05, fold: float = 0.5) -> DataFrame:
    return markers.filter((F.col("pval_adj") < p) & (F.col("logfoldchange") > fold))


def best_per_group(df: DataFrame, groups: list[str], score: Column, key: str, n: int) -> DataFrame:
    """The ``n`` first rows of each group by score, ties to the smaller key, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(score.desc_nulls_last(), key)).cast("long")
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def name_clusters(ranked: DataFrame, groups: list[str], gene: str, score: Column, top: int = 3) -> DataFrame:
    """(groups, label): names of each group's best genes joined by ``_``."""
    best = best_per_group(ranked, groups, score, gene, top)
    return best.groupBy(*groups).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", gene))), lambda s: s[gene]), "_").alias("label"))


def differential_strength(markers: DataFrame, groups: list[str], fold: str, fdr: str, key: str, top: int = 20) -> DataFrame:
    """Per group: median log fold change and mean -log10 FDR of the best ``top`` positive significant markers, how many there are, and how many before the cut."""
    ok = markers.filter((F.col(fdr) < 0.05) & (F.col(fold) > 0) & ~F.isnan(fold) & (F.abs(fold) < float("inf")) & ~F.isnan(fdr))
    n_sig = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    best = best_per_group(ok.withColumn("__sig", n_sig), groups, F.col(fold), key, top)
    return best.groupBy(*groups).agg(F.percentile(fold, F.lit(0.5)).alias("median_log2fc"), F.avg(neg_log10(F.col(fdr))).alias("mean_neglog10_fdr"), F.count(F.lit(1)).alias("n_top"), F.max("__sig").alias("n_sig_markers"))


def select_bfdr(df: DataFrame, by: list[str], p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Genes up to the last place at which the running mean of (1 - p), in descending p, is at most ``alpha``."""
    w = Window.partitionBy(*by).orderBy(F.desc(p), key)
    mean = F.avg(1 - F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("__m", F.round(mean, 12))
    last = F.max(F.when(F.col("__m") <= alpha, F.col("rank"))).over(Window.partitionBy(*by))
    return d.withColumn("__last", last).filter(F.col("rank") <= F.col("__last")).withColumn("bfdr", F.col("__m")).drop("__m", "__last")


def yields(groups: DataFrame, markers: DataFrame, by: list[str], name: str = "n_markers") -> DataFrame:
    """groups with the number of their markers, 0 for a group without any."""
    n = markers.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return groups.join(n, by, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
