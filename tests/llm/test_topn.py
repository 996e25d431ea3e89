import random

from pyspark.sql import functions as F

from spotweave.llm.topn import top_n


def test_top_n_equals_sorting_with_a_hot_group_and_ties(spark):
    r = random.Random(1)
    data = {("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), f"i{i}"): r.choice([None, float("nan"), float("inf"), *map(float, range(6))]) for i in range(3000)}
    df = spark.createDataFrame([(g, i, s, 7) for (g, i), s in data.items()], "g string, i string, s double, __rank int")
    got = {}
    for x in top_n(df.drop("__rank"), ["g"], F.col("s"), "i", 10, salts=8).collect():
        got.setdefault(x["g"], {})[x["rank"]] = x["i"]
    for g in ("hot", "a", "b", None):
        best = sorted((-s, i) for (k, i), s in data.items() if k == g and s is not None and s == s and s != float("inf"))[:10]
        assert [got[g][k] for k in range(1, 11)] == [i for _, i in best]


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 7, 8), ("a", "x", 1.0, 7, 8), ("a", "y", 2.0, 7, 8)], "g string, i string, s double, rank int, __salt int")
    got = top_n(df, ["g"], F.col("s"), "i", 2)
    assert sorted(got.columns) == sorted(df.columns)
    assert {(r["i"], r["rank"], r["__salt"]) for r in got.collect()} == {("y", 1, 8), ("x", 2, 8)}


def test_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", None)], "g string, i string, s double")
    assert [tuple(r) for r in top_n(df, ["g"], F.col("s"), "i", 3).select("g", "i", "rank").collect()] == [("a", "x", 1)]
    assert top_n(df.limit(0), ["g"], F.col("s"), "i", 3).count() == 0
