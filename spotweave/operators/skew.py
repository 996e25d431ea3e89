"""Per-key results when a handful of keys hold most rows.

The rows are range-partitioned on the composite of the key and a secondary order. Spark draws
the range bounds from sampled quantiles of that composite, so a heavy key, which spans many
quantiles, is split over many partitions of about equal size, while light keys stay whole.
Each partition produces one partial state for each key it holds; only those small states are
exchanged a second time and stitched into the key's result. No task ever holds all rows of a
heavy key, and nothing is sampled away, salted twice or dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.session import checkpoint, free_name


def range_split(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Range partitions on (keys, order); heavy keys span several of them."""
    columns = [F.col(c) for c in keys + order]
    return df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)


def split_aggregate(df: DataFrame, keys: list[str], order: list[str], aggregates: list[Column], partitions: int | None = None) -> DataFrame:
    """Per-key aggregates over range-split partitions.

    Catalyst aggregates each range partition into one state per key it holds and exchanges only
    these states, so the exchange that stitches them carries at most (keys + partitions) rows.
    Null keys form their own group, as in any GROUP BY. An empty input gives no rows.
    """
    return range_split(df, keys, order, partitions).groupBy(*keys).agg(*aggregates)


def heavy_keys(df: DataFrame, keys: list[str], order: list[str], total: int, share: float, partitions: int | None = None) -> DataFrame:
    """Keys holding at least ``share`` of ``total`` rows, with their count ``n_rows``."""
    return split_aggregate(df, keys, order, [F.count(F.lit(1)).alias("n_rows")], partitions).filter(F.col("n_rows") >= F.lit(share * total))


def ordered_gaps(df: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """Per key: rows, first and last order value, and the largest gap between neighbours in order.

    ``order`` must be a long column. A result that depends on the order of a key's rows needs
    real stitching: each sorted partition emits (first, last, rows, largest inner gap) per key,
    and the states of a key are folded in order of their first value, adding the gap between
    one partition's last row and the next one's first. A key's states are at most as many as
    there are partitions. Rows with a null key or null order are left out; repeated rows have
    gap 0, and so has a key with one row.
    """
    kind = df.schema[key].dataType
    state = T.StructType([T.StructField("key", kind), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("n", T.LongType()), T.StructField("gap", T.LongType())])

    def states(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            keys, values = batch["key"].to_numpy(), batch["value"].to_numpy(dtype=np.int64)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends = np.concatenate((starts[1:], [len(keys)]))
            gaps = np.diff(values, prepend=values[0])
            gaps[starts] = -1
            out = pd.DataFrame({"key": keys[starts], "first": values[starts], "last": values[ends - 1], "n": ends - starts, "gap": np.maximum.reduceat(gaps, starts)})
            if held is not None:
                if held["key"] == out.at[0, "key"]:
                    out.at[0, "gap"] = max(held["gap"], out.at[0, "gap"], out.at[0, "first"] - held["last"])
                    out.at[0, "first"], out.at[0, "n"] = held["first"], out.at[0, "n"] + held["n"]
                else:
                    yield pd.DataFrame([held])
            held = out.iloc[-1].to_dict()
            if len(out) > 1:
                yield out.iloc[:-1]
        if held is not None:
            yield pd.DataFrame([held])

    rows = df.select(F.col(key).alias("key"), F.col(order).cast("long").alias("value")).filter("key is not null and value is not null")
    partial = range_split(rows, ["key"], ["value"], partitions).sortWithinPartitions("key", "value").mapInPandas(states, state)
    folded = partial.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last", "n", "gap"))).alias("s"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(-1).cast("long").alias("gap"))
    gap = F.aggregate("s", start, lambda a, x: F.struct(x["last"].alias("last"), F.greatest(a["gap"], x["gap"], x["first"] - a["last"]).alias("gap")))
    return folded.select(
        F.col("key").alias(key),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_rows"),
        F.col("s")[0]["first"].alias("first_value"),
        F.element_at("s", -1)["last"].alias("last_value"),
        F.greatest(gap["gap"], F.lit(0).cast("long")).alias("max_gap"),
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], weight: str | None, name: str, partitions: int | None = None) -> DataFrame:
    """df with ``name``: per key, the sum of ``weight`` (of 1 if None) over the rows up to this one in ``order``, without one task per key.

    Rows are added up inside each range partition and shifted by what the same key has in the partitions before, which is read off one
    partial sum per key and partition. The split rows are checkpointed, so that both passes see the same partitions even if an executor is lost.
    ``order`` has to be unique within a key for a reproducible result. Null weights count as 0, null keys are a key. A column called ``name`` is replaced; any other name may occur in df.
    """
    df = df.drop(name)
    pid, part, shifted, local_sum, other = (free_name(df, stem) for stem in ("__part", "__sum", "__shift", "__local", "__k"))
    value = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0).cast(df.schema[weight].dataType))
    split = checkpoint(range_split(df, keys, order, partitions).withColumn(pid, F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    shift = split.groupBy(pid, *keys).agg(F.sum(value).alias(part)).withColumn(shifted, F.sum(part).over(before)).filter(F.col(shifted).isNotNull()).drop(part)
    shift = shift.toDF(*[f"{other}.{i}" for i in range(len(keys) + 1)], shifted)
    local = split.withColumn(local_sum, F.sum(value).over(Window.partitionBy(pid, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = [F.col(c).eqNullSafe(F.col(f"`{other}.{i}`")) for i, c in enumerate([pid, *keys])]
    out = local.join(shift, same, "left")
    return out.select(*[F.col(c) for c in df.columns], (F.col(local_sum) + F.coalesce(shifted, F.lit(0))).alias(name))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``row_number`` per key as a long, by ``running_sum``."""
    return running_sum(df, keys, order, None, name, partitions)


def mean_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, n, name): each distinct value of a key, how many rows have it, and their rank in ascending order, ties averaged.

    Rows are first counted by value in partial aggregates; the counts are added up by ``running_sum``, so a key with any number of rows or values is split.
    Rows with a null value are left out.
    """
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(n, keys, [value], "n", "__up").select(*keys, value, "n", (F.col("__up") - (F.col("n") - 1) / 2.0).alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, marks: dict[str, float]) -> DataFrame:
    """(keys, one column for each name in ``marks``): that quantile of each key's values with linear interpolation, exactly, however many values a key has.

    Values are counted in partial aggregates and the counts added up by ``running_sum``; no task holds a key's values. Null and NaN values are left out,
    and so is a key without others.
    """
    n = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    up = running_sum(n, keys, ["__v"], "__n", "__up")
    top = up.groupBy(*keys).agg((F.sum("__n") - 1).alias("__top"))
    past = lambda q, step: F.min(F.when(F.col("__up") > F.floor(q * F.col("__top")) + step, F.col("__v")))
    ends = up.join(top, keys).groupBy(*keys, "__top").agg(*[past(q, step).alias(f"__{step}{i}") for i, q in enumerate(marks.values()) for step in (0, 1)])

    def between(i: int, q: float) -> Column:
        low, high, at = F.col(f"__0{i}"), F.coalesce(f"__1{i}", f"__0{i}"), q * F.col("__top")
        return low + (high - low) * (at - F.floor(at))

    return ends.select(*keys, *[between(i, q).alias(name) for i, (name, q) in enumerate(marks.items())])


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): one quantile of each key's values, by ``exact_quantiles``."""
    return exact_quantiles(df, keys, value, {name: q})
