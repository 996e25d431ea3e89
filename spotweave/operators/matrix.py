"""Sparse cell-by-gene counts in long form, their quality filters and normalisations.

A dataset (``by``, usually a run) has its own cells and genes. Absent rows are zeros; every mean, variance and rank
adds them back from the number of cells instead of materialising them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.stats import log_norm

#: Parts of the lower-case names of control features.
CONTROL_MARKS = ("negcontrolprobe", "negcontrolcodeword", "negprobe", "blank", "antisense", "unassignedcodeword", "deprecatedcodeword", "intergenic")


def count_matrix(molecules: DataFrame, by: list[str], cell: str, gene: str) -> DataFrame:
    """(by, cell, gene, n): molecules of each gene in each cell. Rows with a null cell or gene count nowhere."""
    return molecules.filter(F.col(cell).isNotNull() & F.col(gene).isNotNull()).groupBy(*by, cell, gene).agg(F.count(F.lit(1)).alias("n"))


def cell_metrics(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """(by, cell, n_counts, n_genes)."""
    return counts.groupBy(*by, cell).agg(F.sum("n").alias("n_counts"), F.count(F.lit(1)).alias("n_genes"))


def gene_metrics(counts: DataFrame, by: list[str], gene: str) -> DataFrame:
    """(by, gene, n_counts, n_cells)."""
    return counts.groupBy(*by, gene).agg(F.sum("n").alias("n_counts"), F.count(F.lit(1)).alias("n_cells"))


def top_genes(counts: DataFrame, by: list[str], gene: str, n: int) -> DataFrame:
    """The rows of each dataset's ``n`` most counted genes; ties go to the smaller name."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_counts"), gene))
    keep = gene_metrics(counts, by, gene).withColumn("r", best).filter(F.col("r") <= n)
    return counts.join(keep.select(*by, gene), [*by, gene], "left_semi")


def min_counts(counts: DataFrame, by: list[str], cell: str, least: int) -> DataFrame:
    """Cells with at least ``least`` counts; a dataset that would be emptied keeps all its cells."""
    m = cell_metrics(counts, by, cell).select(*by, cell, "n_counts")
    low = m.groupBy(*by).agg(F.max("n_counts").alias("top")).filter(F.col("top") < least).select(*by, F.lit(True).alias("emptied"))
    keep = m.join(low, by, "left").filter((F.col("n_counts") >= least) | F.col("emptied"))
    return counts.join(keep.select(*by, cell), [*by, cell], "left_semi")


def _ladder(request: int, steps: tuple[int, ...], reach: Column) -> Column:
    """The largest of the request and the steps below it that ``reach`` attains."""
    tries = sorted({request, *(s for s in steps if s < request)})
    return F.greatest(*[F.when(reach >= t, F.lit(t)).otherwise(F.lit(0)) for t in tries])


def relaxed_filter(counts: DataFrame, by: list[str], cell: str, gene: str, min_genes: int, min_cells: int) -> DataFrame:
    """Cells with enough detected genes, then genes found in enough of these cells; thresholds give way until something is left.

    Each dataset takes the largest viable step of (request, 20, 10, 5, 2, 1) for genes, then of (request, 5, 2, 1) for cells. With at
    least one gene per kept cell some gene threshold always holds, so the two can be read off one after the other.
    """
    cells = cell_metrics(counts, by, cell)
    level = cells.groupBy(*by).agg(F.max("n_genes").alias("top")).select(*by, _ladder(min_genes, (20, 10, 5, 2, 1), F.col("top")).alias("mg"))
    kept = cells.join(level, by).filter(F.col("n_genes") >= F.col("mg")).select(*by, cell)
    counts = counts.join(kept, [*by, cell], "left_semi")
    genes = gene_metrics(counts, by, gene)
    level = genes.groupBy(*by).agg(F.max("n_cells").alias("top")).select(*by, _ladder(min_cells, (5, 2, 1), F.col("top")).alias("mc"))
    kept = genes.join(level, by).filter(F.col("n_cells") >= F.col("mc")).select(*by, gene)
    return counts.join(kept, [*by, gene], "left_semi")


def quantile_filter(counts: DataFrame, by: list[str], cell: str, gene: str, fraction_pattern: str, most_percent: float = 25.0) -> DataFrame:
    """Cells inside adaptive bounds: genes in (max(10, q01), q995), counts above max(20, q01), pattern share below ``most_percent``; all strict."""
    share = 100.0 * F.sum(F.when(F.col(gene).rlike(fraction_pattern), F.col("n")).otherwise(0)) / F.sum("n")
    m = counts.groupBy(*by, cell).agg(F.sum("n").alias("n_counts"), F.count(F.lit(1)).alias("n_genes"), share.alias("percent"))
    q = m.groupBy(*by).agg(F.percentile("n_genes", F.array(F.lit(0.01), F.lit(0.995))).alias("g"), F.percentile("n_counts", F.lit(0.01)).alias("c"))
    low, high = F.greatest(F.lit(10.0), F.col("g")[0]), F.col("g")[1]
    inside = (F.col("n_genes") > low) & (F.col("n_genes") < high) & (F.col("n_counts") > F.greatest(F.lit(20.0), F.col("c"))) & (F.col("percent") < most_percent)
    return m.join(q, by).filter(inside).select(*by, cell, "n_counts", "n_genes", "percent")


def pattern_fraction(counts: DataFrame, by: list[str], cell: str, gene: str, pattern: str) -> DataFrame:
    """(by, cell, n_match, fraction): share of a cell's counts in genes that match; 0 where none does."""
    match = F.sum(F.when(F.col(gene).rlike(pattern), F.col("n")).otherwise(0))
    return counts.groupBy(*by, cell).agg(match.alias("n_match"), (match / F.sum("n")).alias("fraction"))


def is_control(gene: Column, marks: tuple[str, ...] = CONTROL_MARKS) -> Column:
    """Whether the lower-case name contains a control mark."""
    return F.lower(gene).rlike("|".join(marks))


def subtract_background(counts: DataFrame, by: list[str], cell: str, gene: str, control: Column) -> DataFrame:
    """Counts less the cell's mean control count, not below 0, control genes dropped.

    The mean is over the dataset's distinct control genes; a dataset without one is left as it is. Zeros stay zeros, so the long form stays sparse; entries
    that fall to 0 are dropped.
    """
    c = counts.withColumn("__control", F.coalesce(control, F.lit(False)))
    number = c.filter("__control").groupBy(*by).agg(F.countDistinct(gene).alias("__k"))
    load = c.filter("__control").groupBy(*by, cell).agg(F.sum("n").alias("__load"))
    out = c.filter("not __control").join(number, by, "left").join(load, [*by, cell], "left")
    value = F.greatest(F.col("n") - F.coalesce(F.col("__load") / F.col("__k"), F.lit(0.0)), F.lit(0.0))
    return out.select(*by, cell, gene, value.alias("n")).filter("n > 0")


def normalised(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """counts with ``x`` = log1p of counts per ten thousand."""
    library = F.sum("n").over(Window.partitionBy(*by, cell))
    return counts.withColumn("x", log_norm(F.col("n"), library))


def dataset_sizes(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """(by, n_cells)."""
    return counts.select(*by, cell).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"))


def gene_moments(values: DataFrame, by: list[str], cell: str, gene: str, x: str) -> DataFrame:
    """(by, gene, n_cells, mean, variance): over all the dataset's cells, zeros included; sample variance."""
    s = values.groupBy(*by, gene).agg(F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("ss"))
    n, mean = F.col("n_cells"), F.col("s") / F.col("n_cells")
    s = s.join(dataset_sizes(values, by, cell), by)
    return s.select(*by, gene, "n_cells", mean.alias("mean"), ((F.col("ss") - n * mean * mean) / F.nullif(n - 1, F.lit(0))).alias("variance"))


def zscores(values: DataFrame, by: list[str], cell: str, gene: str, x: str, limit: float = 10.0) -> DataFrame:
    """Non-zero entries as (x - mean) / sample deviation, clipped to +-``limit``, with ``zero``, the score of the gene's absent entries.

    A deviation of 0 counts as 1.
    """
    m = gene_moments(values, by, cell, gene, x)
    sd = F.sqrt(F.greatest("variance", F.lit(0.0)))
    sd = F.when(sd > 0, sd).otherwise(1.0)
    clip = lambda v: F.greatest(F.least(v, F.lit(limit)), F.lit(-limit))
    out = values.join(m.select(*by, gene, "mean", sd.alias("sd")), [*by, gene])
    return out.select(*by, cell, gene, clip((F.col(x) - F.col("mean")) / F.col("sd")).alias("z"), clip(-F.col("mean") / F.col("sd")).alias("zero"))


def pearson_residuals(counts: DataFrame, by: list[str], cell: str, gene: str, theta: float = 100.0) -> DataFrame:
    """Residuals of the non-zero entries under a negative binomial with mean row * column / total, clipped at sqrt(cells).

    Row and column sums are aggregates joined back: no task holds all cells of a gene.
    """
    row, column = (counts.groupBy(*by, k).agg(F.sum("n").alias(name)) for k, name in ((cell, "r"), (gene, "c")))
    t = row.groupBy(*by).agg(F.sum("r").alias("t"), F.count(F.lit(1)).alias("m"))
    mu = F.col("r") * F.col("c") / F.col("t")
    value = (F.col("n") - mu) / F.sqrt(mu + mu * mu / theta)
    bound = F.sqrt(F.col("m").cast("double"))
    out = counts.join(row, [*by, cell]).join(column, [*by, gene]).join(t, by)
    return out.select(*by, cell, gene, F.greatest(F.least(value, bound), -bound).alias("residual"))


def variable_genes(counts: DataFrame, by: list[str], cell: str, gene: str, n: int = 2000, bins: int = 20) -> DataFrame:
    """(by, gene, mean, dispersion, score, rank): genes with the highest dispersion for their mean.

    Log dispersion (variance / mean of depth-normalised counts) is standardised within ``bins`` equal-width bins of log1p(mean); a bin of one gene
    scores 1. Genes with a zero mean or dispersion have no score. Ties go to the smaller name.
    """
    library = F.sum("n").over(Window.partitionBy(*by, cell))
    m = gene_moments(counts.withColumn("y", F.col("n") * 1e4 / library), by, cell, gene, "y")
    m = m.filter("mean > 0 and variance > 0").withColumn("d", F.log(F.col("variance") / F.col("mean"))).withColumn("l", F.log1p("mean"))
    w = Window.partitionBy(*by)
    low, width = F.min("l").over(w), (F.max("l").over(w) - F.min("l").over(w)) / bins
    m = m.withColumn("bin", F.when(width > 0, F.least(F.floor(F.round((F.col("l") - low) / width, 9)), F.lit(bins - 1))).otherwise(0))
    b = Window.partitionBy(*by, "bin")
    sd = F.stddev_samp("d").over(b)
    m = m.withColumn("score", F.when(sd > 1e-12, (F.col("d") - F.avg("d").over(b)) / sd).otherwise(1.0))
    rank = F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), gene))
    return m.withColumn("rank", rank).filter(F.col("rank") <= n).select(*by, gene, "mean", F.exp("d").alias("dispersion"), "score", F.col("rank").cast("long").alias("rank"))


def wide_matrix(counts: DataFrame, by: list[str], cell: str, gene: str, genes: list[str]) -> DataFrame:
    """One column for each of ``genes``, zeros filled in. The list is given, so no pass is needed to find it; cells with none of them are left out."""
    return counts.filter(F.col(gene).isin(genes)).groupBy(*by, cell).pivot(gene, genes).sum("n").na.fill(0, genes)


def dense_rows(counts: DataFrame, by: list[str], cell: str, gene: str, panel: DataFrame, order: str, name: str) -> DataFrame:
    """(by, cell, n_outside, line): every cell's counts of all the panel's genes in the panel's order, joined by commas, and how many counts lie outside it.

    This is the line of the dense cell-by-gene file. ``panel`` is a fixed, small table; it travels as one row. Cells without any gene of the panel have zeros.
    """
    genes = panel.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("g")).agg(F.min(order).alias("o")).groupBy(F.lit(0).alias("__k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "g"))), lambda s: s["g"]).alias("__genes"))
    rows = counts.groupBy(*by, cell).agg(F.map_from_entries(F.collect_list(F.struct(gene, "n"))).alias("__n"), F.sum("n").alias("__all")).withColumn("__k", F.lit(0)).join(F.broadcast(genes), "__k", "left")
    values = F.transform(F.coalesce("__genes", F.array().cast("array<string>")), lambda g: F.coalesce(F.col("__n")[g], F.lit(0).cast("long")))
    rows = rows.withColumn("__values", values)
    inside = F.aggregate("__values", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*by, cell, (F.col("__all") - inside).alias("n_outside"), F.array_join(F.transform("__values", lambda v: v.cast("string")), ",").alias("line"))


def quality_filter(molecules: DataFrame, quality: str, gene: str, cell: str, least: float = 20.0, noise: str | None = None) -> DataFrame:
    """Molecules of at least the quality ``least`` that are no control and lie in a cell; of a table with a ``noise`` column, those it marks false.

    A null or NaN quality, a null gene, a null cell or a null mark is left out.
    """
    ok = (F.col(quality) >= least) & ~F.isnan(quality) & ~is_control(F.col(gene)) & F.col(cell).isNotNull()
    if noise is not None and noise in molecules.columns:
        ok = ok & ~F.col(noise)
    return molecules.filter(ok)


def molecule_centroids(molecules: DataFrame, by: list[str], cell: str, coordinates: list[str]) -> DataFrame:
    """(by, cell, n, mean of each coordinate): nulls and NaNs of a coordinate do not count."""
    mean = [F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in coordinates]
    return molecules.filter(F.col(cell).isNotNull()).groupBy(*by, cell).agg(F.count(F.lit(1)).alias("n"), *mean)


def histogram(values: DataFrame, by: list[str], value: str, bins: int = 50) -> DataFrame:
    """(by, bin, low, n): counts in ``bins`` equal bins between each group's extremes, the last one closed; a group of one value has one bin. Empty bins have no row."""
    ok = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = ok.groupBy(*by).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(width > 0, F.least(F.floor(F.round((F.col(value) - F.col("__lo")) / width, 9)), F.lit(bins - 1))).otherwise(0).cast("int")
    return ok.join(ends, by).groupBy(*by, place.alias("bin"), (F.col("__lo") + place * width).alias("low")).agg(F.count(F.lit(1)).alias("n"))


def five_numbers(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, least, q1, median, mean, q3, most) of each group's values; nulls and NaNs are left out. Quantiles are exact and split over tasks."""
    from spotweave.operators.skew import exact_quantile

    ok = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    out = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        out = out.join(exact_quantile(ok, by, value, q, name), by)
    return out.select(*by, "n", "least", "q1", "median", "mean", "q3", "most")


def triplets(counts: DataFrame, cell: str, gene: str) -> DataFrame:
    """(row, col, value) of the genes x cells coordinate matrix, 1-based positions in sorted order.

    Positions come from numbering the distinct names, which are far fewer than the entries, over range partitions.
    """
    from spotweave.operators.skew import number_rows

    def place(column: str, name: str) -> DataFrame:
        names = counts.select(column).distinct().withColumn("__all", F.lit(0))
        return number_rows(names, ["__all"], [column], name).select(column, name)

    return counts.join(place(gene, "row"), gene).join(place(cell, "col"), cell).select("row", "col", F.col("n").alias("value"))
