"""The N best items of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.session import free_name


def top_n(df: DataFrame, groups: list[str], score: Column, item: str, n: int, salts: int = 32) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``; ties go to the smaller ``item`` in byte order.

    Stage one hashes each group's items into ``salts`` subgroups and keeps the best ``n`` of each (Spark also limits each
    group before the shuffle, on the map side); stage two ranks the at most ``salts * n`` survivors of a group. A group that
    holds a third of all rows is thus ranked by ``salts`` tasks. Items have to be unique within a group for a reproducible
    cut. Rows whose score is null, NaN or infinite are left out; null group values form a group; all come out of groups with fewer rows.
    The place comes out as ``rank``; a column of that name is replaced, and any other name may occur in ``df``.
    """
    s, salt, rank = (free_name(df, stem) for stem in ("__score", "__salt", "__rank"))
    rows = df.withColumn(s, score.cast("double")).filter(F.col(s).isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(item), F.lit(salts)))
    best = [F.col(s).desc(), F.col(item).asc()]
    kept = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*groups, salt).orderBy(*best))).filter(F.col(rank) <= n).drop(rank, salt)
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*best))).filter(F.col(rank) <= n).withColumn("rank", F.col(rank)).drop(s, rank)
