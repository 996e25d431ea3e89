"""Keep the state of a record that was loaded last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], when: str, columns: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``when``.

    A maximum over a struct aggregates partially before the shuffle, so neither repeated
    rows nor a key with very many states reach one task. Equal ``when`` values: the greatest
    ``columns`` in their order win (nulls smallest), so the result never depends on row order.
    Rows with a null key form a group of their own; a null ``when`` loses to any other.
    Only ``keys``, ``when`` and ``columns`` come out, so extra columns cannot clash.
    """
    rest = [c for c in columns if c not in keys and c != when]
    best = F.max(F.struct(F.col(when), *[F.col(c) for c in rest])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"__best.`{when}`").alias(when), *[F.col(f"__best.`{c}`").alias(c) for c in rest])
