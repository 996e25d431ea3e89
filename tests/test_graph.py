import random
import time

import numpy as np
import pytest

from spotweave.operators.graph import connected_components
from spotweave.operators.knn import knn_plane, knn_vectors


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000), (None, 3)] + [(2000 + r.randrange(80), 2000 + r.randrange(80)) for _ in range(60)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {a: root(a) for a in list(parent)}
    low = {}
    for a, c in want.items():
        low[c] = min(low.get(c, a), a)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {a: low[c] for a, c in want.items()}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_knn_plane_equals_brute_force(spark):
    r = random.Random(2)
    data = [("A", i, r.choice([r.gauss(0, 1), 50 + r.gauss(0, 0.01)]), r.gauss(0, 1)) for i in range(160)] + [("A", 500 + i, 3.0, 3.0) for i in range(6)] + [("B", 1, 0.0, 0.0), ("B", 2, 1.0, 0.0), ("C", 9, 1.0, 1.0), ("A", 900, None, 1.0), ("A", 901, float("nan"), 1.0)]
    df = spark.createDataFrame(data, "run string, id long, x double, y double")
    for own, tile in ((False, 2048), (True, 2048), (False, 12), (True, 4)):
        want = {}
        for run, i, x, y in data:
            if x is None or x != x:
                continue
            near = sorted(((x - b) ** 2 + (y - c) ** 2, j) for s, j, b, c in data if s == run and b is not None and b == b and (own or j != i))[:5]
            want.update({(run, i, k): j for k, (_, j) in enumerate(near, 1)})
        got = {(x["run"], x["src"], x["rank"]): x["dst"] for x in knn_plane(df, ["run"], "id", "x", "y", 5, own, tile).collect()}
        assert got == want


def test_components_are_whole_or_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {x["component"] for x in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=2)


def test_a_crowd_and_a_far_point_cost_no_more_than_an_even_plane(spark):
    g = np.random.default_rng(4)
    took = []
    for m in (g.uniform(size=(8000, 2)) * 100, np.concatenate([g.uniform(size=(7999, 2)), [[1e6, 1e6]]]), np.concatenate([np.ones((7000, 2)), g.uniform(size=(1000, 2))])):
        df = spark.createDataFrame([("A", i, float(a), float(b)) for i, (a, b) in enumerate(m)], "run string, id long, x double, y double").cache()
        df.count()
        began = time.perf_counter()
        got = {(r["src"], r["rank"]): r["dst"] for r in knn_plane(df, ["run"], "id", "x", "y", 6).collect()}
        took.append(time.perf_counter() - began)
        for i in (0, 7999, 4321):
            d = ((m - m[i]) ** 2).sum(1)
            d[i] = np.inf
            assert [got[i, k] for k in range(1, 7)] == list(np.lexsort((np.arange(8000), d))[:6])
    assert max(took[1:]) < 2 * took[0] + 2


def test_knn_vectors_equals_brute_force(spark):
    m = np.random.default_rng(1).normal(size=(150, 8))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(m)] + [(999, None)], "id long, v array<double>")
    got = {(x["src"], x["rank"]): x["dst"] for x in knn_vectors(df, df.filter("id % 20 = 0"), "id", "v", 4, block=3).collect()}
    for i in range(0, 150, 20):
        d = np.sqrt(((m - m[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i, k] for k in range(1, 5)] == list(np.argsort(d)[:4])
    assert knn_vectors(df, df.limit(0), "id", "v", 4).count() == 0
