"""Column expressions of the statistics that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def log_norm(n: Column, library: Column, target: float = 1e4) -> Column:
    """log(1 + n / library * target); an empty library counts as 1."""
    return F.log1p(n / F.when(library == 0, 1.0).otherwise(library) * target)


def log2_fold(mean_in: Column, mean_out: Column, floor: float = 1.0) -> Column:
    """log2 of the ratio of two back-transformed means of logs, each raised by ``floor``."""
    return F.log2((F.expm1(mean_in) + floor) / (F.expm1(mean_out) + floor))


def specificity(fold: Column, pct_in: Column, pct_out: Column) -> Column:
    """Fold change weighted by how much more often the gene is detected inside."""
    return fold * pct_in * (pct_in - pct_out + 1)


def min_max(value: Column, groups: list[str]) -> Column:
    """Value scaled to [0, 1] within its group; null where the group has one value only."""
    w = Window.partitionBy(*groups)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return (value - low) / F.nullif(high - low, F.lit(0.0))


def rank_score(value: Column, groups: list[str]) -> Column:
    """(n - rank) / (n - 1) with average ties and rank 1 the largest; 1 for a group of one; null stays null."""
    by = Window.partitionBy(*groups, value.isNull())
    first = F.rank().over(by.orderBy(value.desc()))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*groups, value))
    n = F.count(value).over(Window.partitionBy(*groups))
    mean_rank = first + (peers - 1) / 2.0
    return F.when(value.isNull(), None).when(n == 1, 1.0).otherwise((n - mean_rank) / (n - 1))


def competition_rank(value: Column, groups: list[str]) -> Column:
    """Rank 1 for the largest, equal values share the smallest rank; null stays null."""
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(*groups).orderBy(value.desc_nulls_last())))


def neg_log10(p: Column) -> Column:
    """-log10(p), p floored at 1e-300."""
    return -F.log10(F.greatest(p, F.lit(1e-300)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def softmax(v: Column, sharpen: float = 1.0) -> Column:
    """Softmax of an array; with ``sharpen`` its powers are normalised again."""
    share = lambda powers: bind(F.aggregate(powers, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(powers, lambda x: x / total))
    raised = lambda v, top: F.transform(v, lambda x: F.exp((x - top) * sharpen))
    return bind(v, lambda v: bind(F.array_max(v), lambda top: bind(raised(v, top), share)))


def entropy(p: Column) -> Column:
    """-sum p log(p + 1e-12) of an array."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(x + 1e-12))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The array divided by its Euclidean length; a zero array stays zero."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x * x))
    return bind(length, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def restrict_levels(value: Column, levels: list[str]) -> Column:
    """The value if it is one of the levels, else null."""
    return F.when(value.isin(levels), value)


def portable_hash(*parts: Column) -> Column:
    """A 32-bit hash that other engines can repeat: the first eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *parts)), 1, 8), 16, 10).cast("long")
