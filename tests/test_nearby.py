import random
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spotweave.operators.nearby import close_pairs, points_in_regions


def brute(data, radius):
    out = set()
    for i, (run, a, x, y, own) in enumerate(data):
        for run2, b, x2, y2, own2 in data[i + 1 :]:
            if run == run2 and own is not None and own2 is not None and own != own2 and None not in (x, y, x2, y2) and (x - x2) ** 2 + (y - y2) ** 2 <= radius * radius:
                out.add((min(a, b), max(a, b)))
    return out


def points(seed, n, spread):
    r = random.Random(seed)
    return [("A" if r.random() < 0.7 else "B", i, r.randrange(int(spread * 64)) / 64, r.randrange(int(spread * 64)) / 64, r.choice(["c1", "c2", "c3", None])) for i in range(n)]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000), st.sampled_from([(300, 12.0), (300, 2.0)]))
def test_close_pairs_equals_brute_force_sparse_and_crowded(spark, seed, shape):
    data = points(seed, *shape)
    df = spark.createDataFrame(data, "run string, id long, x double, y double, own string")
    for crowded in (16, 10_000):
        got = [tuple(r) for r in close_pairs(df, "run", "id", "x", "y", "own", 0.75, crowded).select("a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(data, 0.75)


def test_a_crowd_of_one_owner_makes_no_candidates(spark):
    r = random.Random(7)
    data = [("A", i, r.random() / 8, r.random() / 8, "own" if i % 4000 else f"other{i}") for i in range(8000)]
    df = spark.createDataFrame(data, "run string, id long, x double, y double, own string")
    began = time.perf_counter()
    assert {tuple(x) for x in close_pairs(df, "run", "id", "x", "y", "own", 0.75).select("a", "b").collect()} == brute([d for d in data if d[4] != "own"], 0.75) | {(min(a, b), max(a, b)) for a in (0, 4000) for b in range(8000) if b % 4000}
    assert time.perf_counter() - began < 60


def test_close_pairs_bad_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    data = [("A", 1, 0.0, 0.0, "p", 9), ("A", 2, 0.75, 0.0, "q", 9), ("A", 3, nan, 0.0, "r", 9), ("A", 4, inf, 0.0, "r", 9), ("A", 5, None, 0.0, "r", 9), ("A", 6, 0.0, 0.0, None, 9), (None, 7, 0.0, 0.0, "r", 9), ("A", 8, -0.5, -0.5, "s", 9)]
    df = spark.createDataFrame(data, "run string, id long, x double, y double, own string, gx long")
    assert {tuple(r)[1:] for r in close_pairs(df, "run", "id", "x", "y", "own", 0.75).collect()} == {(1, 2, "p", "q"), (1, 8, "p", "s")}
    assert close_pairs(df.limit(0), "run", "id", "x", "y", "own", 0.75).count() == 0


def inside(x, y, corners):
    n = len(corners)
    return all((corners[(i + 1) % n][0] - corners[i][0]) * (y - corners[i][1]) - (corners[(i + 1) % n][1] - corners[i][1]) * (x - corners[i][0]) >= 0 for i in range(n))


def test_points_in_convex_regions(spark):
    r = random.Random(5)
    shapes = {"tri": [(1.0, 1.0), (9.0, 2.0), (4.0, 8.0)], "box": [(3.0, 3.0), (12.0, 3.0), (12.0, 6.0), (3.0, 6.0)], "bad": [(0.0, 0.0), (1.0, 1.0)]}
    pts = [("A", i, r.uniform(-1, 13), r.uniform(-1, 10)) for i in range(600)] + [("A", 1000, 3.0, 3.0), ("A", 1001, None, 2.0), ("B", 1002, 5.0, 4.0)]
    p = spark.createDataFrame(pts, "run string, id long, x double, y double")
    g = spark.createDataFrame([("A", k, [{"x": x, "y": y} for x, y in v]) for k, v in shapes.items()] + [("A", "null", None)], "run string, region string, corners array<struct<x double, y double>>")
    got = {(x["id"], x["region"]) for x in points_in_regions(p, "run", "id", "x", "y", g, "region", "corners", 2.0, 2).collect()}
    want = {(i, k) for run, i, x, y in pts for k, v in shapes.items() if run == "A" and x is not None and len(v) > 2 and inside(x, y, v)}
    assert got == want
