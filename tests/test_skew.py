import collections
import random

import numpy as np

from pyspark.sql import functions as F

from spotweave.operators.latest import latest_rows
from spotweave.operators.skew import exact_quantiles, heavy_keys, number_rows, ordered_gaps, range_split, split_aggregate


def rows(n=4000):
    r = random.Random(3)
    return [("hot" if r.random() < 0.4 else None if r.random() < 0.05 else f"k{r.randrange(50)}", i % 977, r.random()) for i in range(n)]


def test_split_aggregate_equals_plain_and_splits_the_heavy_key(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o long, v double")
    got = {r["k"]: r["n"] for r in split_aggregate(df, ["k"], ["o"], [F.count("*").alias("n")], 8).collect()}
    assert got == dict(collections.Counter(k for k, _, _ in data))
    parts = range_split(df, ["k"], ["o"], 8).filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3


def test_heavy_keys(spark):
    df = spark.createDataFrame(rows(), "k string, o long, v double").filter("k is not null")
    assert [r["k"] for r in heavy_keys(df, ["k"], ["o"], 4000, 0.1).collect()] == ["hot"]
    assert heavy_keys(df.limit(0), ["k"], ["o"], 0, 0.1).count() == 0


def test_ordered_gaps_with_ties_nulls_and_one_row(spark):
    data = [(k, o) for k, o, _ in rows()] + [("one", 5), ("none", None), (None, 3)]
    got = {r["k"]: (r["n_rows"], r["first_value"], r["last_value"], r["max_gap"]) for r in ordered_gaps(spark.createDataFrame(data, "k string, o long"), "k", "o", 7).collect()}
    want = collections.defaultdict(list)
    for k, o in data:
        if k is not None and o is not None:
            want[k].append(o)
    for k, v in want.items():
        v.sort()
        assert got[k] == (len(v), v[0], v[-1], max([b - a for a, b in zip(v, v[1:])], default=0))
    assert "none" not in got and set(got) == set(want)
    assert ordered_gaps(spark.createDataFrame([], "k string, o long"), "k", "o").count() == 0


def test_number_rows(spark):
    data = [(k or "x", i) for i, (k, _, _) in enumerate(rows())]
    got = number_rows(spark.createDataFrame(data, "k string, i long"), ["k"], ["i"], "no", 6).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["k"]].append((r["i"], r["no"]))
    for v in by.values():
        assert [no for _, no in sorted(v)] == list(range(1, len(v) + 1))


def test_running_sums_leave_clashing_columns_alone(spark):
    df = spark.createDataFrame([("a", 1, 9, 5), ("a", 2, 9, 6), (None, 3, 9, 7)], "k string, o long, __part long, __shift long")
    got = {tuple(r) for r in number_rows(df, ["k"], ["o"], "no").collect()}
    assert got == {("a", 1, 9, 5, 1), ("a", 2, 9, 6, 2), (None, 3, 9, 7, 1)}
    assert number_rows(df.withColumn("no", F.lit(0)), ["k"], ["o"], "no").columns == [*df.columns, "no"]
    assert number_rows(df.limit(0), ["k"], ["o"], "no").count() == 0


def test_exact_quantiles_equal_numpy(spark):
    g = np.random.default_rng(5)
    data = {k: [float(v) for v in g.integers(0, 40, n)] for k, n in (("hot", 900), ("one", 1), ("two", 2))}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    got = {r["k"]: (r["low"], r["mid"], r["end"]) for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"low": 0.1, "mid": 0.5, "end": 1.0}).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert np.allclose(got[k], np.quantile(vs, [0.1, 0.5, 1.0]))


def test_latest_rows_ties_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, "a", 0), (1, 5, "b", 0), (1, None, "z", 0), (2, None, None, 0), (None, 1, "n", 0)], "id long, t long, v string, __best long")
    got = {r["id"]: (r["t"], r["v"]) for r in latest_rows(df, ["id"], "t", ["v"]).collect()}
    assert got == {1: (5, "b"), 2: (None, None), None: (1, "n")}
