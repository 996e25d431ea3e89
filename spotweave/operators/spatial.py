"""Spatial statistics on neighbour edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.stats import portable_hash
from spotweave.operators.skew import exact_quantile, number_rows
from spotweave.session import checkpoint


def neighbour_labels(edges: DataFrame, labels: DataFrame, by: list[str], cell: str, label: str) -> DataFrame:
    """(by, src, label, votes): labels among each cell's neighbours; unlabelled neighbours do not vote."""
    l = labels.select(*by, F.col(cell).alias("dst"), F.col(label).alias("label"))
    return edges.join(l, [*by, "dst"]).groupBy(*by, "src", "label").agg(F.count(F.lit(1)).alias("votes"))


def majority_label(edges: DataFrame, labels: DataFrame, by: list[str], cell: str, label: str) -> DataFrame:
    """(by, src, label, votes, share): the most frequent neighbour label, ties to the smaller; share of all voting neighbours."""
    v = neighbour_labels(edges, labels, by, cell, label)
    w = Window.partitionBy(*by, "src")
    v = v.withColumn("share", F.col("votes") / F.sum("votes").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("votes"), "label")))
    return v.filter("r = 1").drop("r")


def denoise_labels(edges: DataFrame, labels: DataFrame, by: list[str], cell: str, label: str, confidence: str, share: float = 0.65, passes: int = 2) -> DataFrame:
    """(by, cell, label): cells of at most median confidence take the neighbours' majority label where its share is at least ``share``.

    ``passes`` synchronous rounds; a round that changes nothing makes the next one a repetition.
    """
    state = labels.select(*by, cell, F.col(label).alias("label"), F.col(confidence).alias("c"))
    cut = exact_quantile(state, by, "c", 0.5, "cut")
    state = state.join(cut, by)
    for _ in range(passes):
        m = majority_label(edges, state, by, cell, "label").select(*by, F.col("src").alias(cell), F.col("label").alias("__to"), F.col("share").alias("__share"))
        swap = (F.col("c") <= F.col("cut")) & (F.col("__share") >= share)
        state = state.join(m, [*by, cell], "left").withColumn("label", F.when(swap, F.col("__to")).otherwise(F.col("label"))).select(*by, cell, "label", "c", "cut")
    return state.select(*by, cell, "label")


def label_diversity(edges: DataFrame, labels: DataFrame, by: list[str], cell: str, label: str) -> DataFrame:
    """(by, src, entropy): Shannon entropy (natural log) of the labels among a cell's neighbours; absent labels add nothing."""
    v = neighbour_labels(edges, labels, by, cell, label)
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy(*by, "src"))
    return v.withColumn("p", share).groupBy(*by, "src").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def hotspots(values: DataFrame, by: list[str], value: str, quantile: float = 0.95) -> DataFrame:
    """Rows at or above their dataset's quantile."""
    cut = exact_quantile(values, by, value, quantile, "__cut")
    return values.join(cut, by).filter(F.round(value, 9) >= F.round("__cut", 9)).drop("__cut")


def morans_i(values: DataFrame, edges: DataFrame, cells: DataFrame, by: list[str], cell: str, gene: str, x: str, min_cells: int = 10) -> DataFrame:
    """(by, gene, moran, expected, variance, z): Moran's I under row-standardised neighbour weights, with its randomisation variance.

    Only non-zero entries travel: with lag x the neighbour mean, sum z lag z = sum x lag x - mean sum lag x - mean sum x + N mean^2, where the absent
    entries' lags come from the edges of the present ones. Genes in fewer than ``min_cells`` cells or without variance are left out. ``cells`` has all
    cells of a dataset; cells without any edge count with weight zero.
    """
    degree = edges.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("k"))
    w = edges.join(degree, [*by, "src"]).select(*by, "src", "dst", (1.0 / F.col("k")).alias("w"))
    w = checkpoint(w)
    n = cells.select(*by, cell).distinct().groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    back = w.select(*by, F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("wb"))
    both = F.coalesce("w", F.lit(0.0)) + F.coalesce("wb", F.lit(0.0))
    s1 = w.join(back, [*by, "src", "dst"], "full").groupBy(*by).agg((F.sum(both * both) / 2).alias("s1"))
    ends = w.select(*by, F.col("src").alias("c"), F.col("w")).unionByName(w.select(*by, F.col("dst").alias("c"), F.col("w")))
    s2 = ends.groupBy(*by, "c").agg((F.sum("w") ** 2).alias("t")).groupBy(*by).agg(F.sum("t").alias("s2"))
    s0 = w.groupBy(*by).agg(F.sum("w").alias("s0"))
    v = values.select(*by, cell, gene, F.col(x).alias("x")).join(cells.select(*by, cell).distinct(), [*by, cell])
    row = w.groupBy(*by, F.col("src").alias(cell)).agg(F.sum("w").alias("rw"))
    col = w.groupBy(*by, F.col("dst").alias(cell)).agg(F.sum("w").alias("cw"))
    v = v.join(row, [*by, cell], "left").join(col, [*by, cell], "left").na.fill(0.0, ["rw", "cw"])
    m = v.groupBy(*by, gene).agg(F.count(F.lit(1)).alias("nz"), *[F.sum(F.col("x") ** i).alias(f"m{i}") for i in (1, 2, 3, 4)], F.sum(F.col("x") * F.col("rw")).alias("xr"), F.sum(F.col("x") * F.col("cw")).alias("xc"))
    near = v.select(*by, F.col(cell).alias("dst"), gene, F.col("x").alias("xj"))
    cross = v.select(*by, F.col(cell).alias("src"), gene, "x").join(w, [*by, "src"]).join(near, [*by, "dst", gene]).groupBy(*by, gene).agg(F.sum(F.col("w") * F.col("x") * F.col("xj")).alias("cross"))
    t = m.join(cross, [*by, gene], "left").na.fill(0.0, ["cross"]).join(n, by).join(s0, by).join(s1, by).join(s2, by)
    N, mean = F.col("n"), F.col("m1") / F.col("n")
    t = t.withColumn("mean", mean).withColumn("v2", F.col("m2") - N * mean * mean)
    t = t.withColumn("v4", F.col("m4") - 4 * F.col("mean") * F.col("m3") + 6 * F.col("mean") ** 2 * F.col("m2") - 4 * F.col("mean") ** 3 * F.col("m1") + N * F.col("mean") ** 4)
    t = t.filter((F.col("nz") >= min_cells) & (F.col("v2") > 1e-12))
    zz = F.col("cross") - F.col("mean") * (F.col("xr") + F.col("xc")) + F.col("mean") ** 2 * F.col("s0")
    moran = N / F.col("s0") * zz / F.col("v2")
    expected = -1.0 / (N - 1)
    b2 = N * F.col("v4") / (F.col("v2") ** 2)
    S0, S1, S2 = F.col("s0"), F.col("s1"), F.col("s2")
    variance = (N * ((N**2 - 3 * N + 3) * S1 - N * S2 + 3 * S0**2) - b2 * ((N**2 - N) * S1 - 2 * N * S2 + 6 * S0**2)) / ((N - 1) * (N - 2) * (N - 3) * S0**2) - expected**2
    t = t.select(*by, gene, moran.alias("moran"), expected.alias("expected"), variance.alias("variance"))
    return t.withColumn("z", (F.col("moran") - F.col("expected")) / F.sqrt("variance"))


def spatial_magnitude(moran: DataFrame, by: list[str], value: str, significant: str) -> DataFrame:
    """(by, median_moran, mean_moran, pct_sig, magnitude): 0.6 * median + 0.4 * significant share."""
    a = moran.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median_moran"), F.avg(value).alias("mean_moran"), (100.0 * F.avg(F.col(significant).cast("double"))).alias("pct_sig"))
    return a.withColumn("magnitude", 0.6 * F.col("median_moran") + 0.4 * F.col("pct_sig") / 100.0)


def paired_complete(df: DataFrame, key: list[str], method: str, value: str, methods: list[str]) -> DataFrame:
    """One row for each key that has a value for every method, one column for each."""
    return df.groupBy(*key).pivot(method, methods).agg(F.max(value)).na.drop(subset=methods)


def bootstrap_medians(pairs: DataFrame, by: list[str], key: str, methods: list[str], replicates: int, seed: int = 1) -> DataFrame:
    """(by, replicate, one median for each method): the same resampled keys for all methods in a replicate.

    The i-th draw of a replicate is the row whose position is a portable hash modulo the number of rows, so a draw is an equi-join on
    (by, position) that any engine repeats. Rows are numbered by ``key``; draws are made where the rows are counted and joined once.
    """
    rows = number_rows(pairs, by, [key], "pos").withColumn("pos", F.col("pos") - 1)
    size = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    draw = size.select(*by, "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    draw = draw.withColumn("pos", F.pmod(portable_hash(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("i").cast("string")), F.col("n")))
    return draw.join(rows, [*by, "pos"]).groupBy(*by, "replicate").agg(*[F.percentile(m, F.lit(0.5)).alias(m) for m in methods])


def bootstrap_verdicts(pairs: DataFrame, by: list[str], key: str, methods: list[str], replicates: int = 1000, seed: int = 1, confidence: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(per method, per pair of methods) from the paired bootstrap of medians.

    Per method: (by, method, observed, ci_low, ci_high, place), place 1 the largest. Per pair: (by, method_a, method_b, diff, ci_low, ci_high, p, p_adj, verdict):
    p is twice the smaller share of replicates on either side of 0, between 1 / replicates and 1; p_adj is Benjamini-Hochberg among a dataset's pairs; the verdict
    names the larger method where the interval leaves out 0.
    """
    from itertools import combinations

    from spotweave.operators.markers import adjust_bh

    a = (1 - confidence) / 2
    boot = checkpoint(bootstrap_medians(pairs, by, key, methods, replicates, seed))
    quantile = lambda c, p: F.percentile(c, F.lit(p))
    seen = pairs.groupBy(*by).agg(*[quantile(m, 0.5).alias(f"seen_{m}") for m in methods])
    two = list(combinations(methods, 2))
    both = boot.groupBy(*by).agg(
        *[quantile(m, p).alias(f"{n}_{m}") for m in methods for n, p in (("low", a), ("high", 1 - a))],
        *[quantile(F.col(x) - F.col(y), p).alias(f"{n}_{x}_{y}") for x, y in two for n, p in (("low", a), ("high", 1 - a))],
        *[F.least(F.avg((F.col(x) - F.col(y) <= 0).cast("double")), F.avg((F.col(x) - F.col(y) >= 0).cast("double"))).alias(f"side_{x}_{y}") for x, y in two],
    ).join(seen, by)
    one = both.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"seen_{m}").alias("observed"), F.col(f"low_{m}").alias("ci_low"), F.col(f"high_{m}").alias("ci_high")) for m in methods])).alias("t")).select(*by, "t.*")
    one = one.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("observed", 9)), "method")).cast("long"))
    rows = [F.struct(F.lit(x).alias("method_a"), F.lit(y).alias("method_b"), (F.col(f"seen_{x}") - F.col(f"seen_{y}")).alias("diff"), F.col(f"low_{x}_{y}").alias("ci_low"), F.col(f"high_{x}_{y}").alias("ci_high"), F.least(F.greatest(2 * F.col(f"side_{x}_{y}"), F.lit(1 / replicates)), F.lit(1.0)).alias("p")) for x, y in two]
    pair = both.select(*by, F.explode(F.array(*rows)).alias("t")).select(*by, "t.*").withColumn("__k", F.concat_ws("/", "method_a", "method_b"))
    pair = adjust_bh(pair, by, "p", "p_adj", "__k").drop("__k")
    apart = (F.round("ci_low", 12) > 0) | (F.round("ci_high", 12) < 0)
    text = F.when(apart & (F.col("diff") > 0), F.concat_ws(" > ", "method_a", "method_b")).when(apart & (F.col("diff") < 0), F.concat_ws(" > ", "method_b", "method_a")).otherwise("tie (CI spans 0)")
    return one, pair.withColumn("verdict", text)


def permuted_cells(cells: DataFrame, by: list[str], cell: str, coordinates: list[str], seed: int = 1) -> DataFrame:
    """cells whose ``coordinates`` have changed places within their dataset, by a portable hash: the null model of a spatial statistic.

    The i-th cell by name takes the coordinates of the i-th cell by hash; both are numbered over range partitions.
    """
    named = number_rows(cells.drop(*coordinates), by, [cell], "__i")
    hashed = cells.select(*by, *coordinates, portable_hash(F.lit(str(seed)), F.col(cell).cast("string")).alias("__h"), F.col(cell).alias("__c"))
    moved = number_rows(hashed, by, ["__h", "__c"], "__i").select(*by, "__i", *coordinates)
    return named.join(moved, [*by, "__i"]).drop("__i")
