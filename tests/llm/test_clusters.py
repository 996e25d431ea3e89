import collections

import numpy as np
import pytest

from spotweave.llm.clusters import describe_clusters, leaf_features, linked_sets, plane_points, ward, ward_clusters


def brute(rows, step, least):
    pts = {}
    for g, i, x, y in rows:
        if None not in (g, i, x, y) and np.isfinite([x, y]).all():
            pts[g, i] = max(pts.get((g, i), (x, y)), (x, y))
    out = {}
    for g in {g for g, _ in pts}:
        ids = sorted(i for k, i in pts if k == g)
        m = np.array([pts[g, i] for i in ids])
        near, label = ((m[:, None] - m[None]) ** 2).sum(-1) <= step * step, np.arange(len(ids))
        while True:
            new = np.array([label[row].min() for row in near])
            if (new == label).all():
                break
            label = new
        size = collections.Counter(label)
        out.update({(g, i): ids[l] for i, l in zip(ids, label) if size[l] >= least})
    return out


@pytest.mark.parametrize("spread", [0.4, 3.0, 9.0])
def test_linked_sets_equal_brute_force(spark, spread):
    g = np.random.default_rng(int(spread * 10))
    rows = [("A" if g.random() < 0.8 else "B", f"c{i:03d}", *(float(v) for v in np.round(g.normal(0, spread, 2) * 64) / 64)) for i in range(300)]
    rows += [("A", "c000", 50.0, 50.0), ("A", "n1", None, 0.0), ("A", "n2", float("nan"), 0.0), (None, "n3", 0.0, 0.0), ("A", None, 0.0, 0.0)]
    rows += [("A", f"same{i}", 7.0, 7.0) for i in range(6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "run string, cell string, u double, v double, grp int")
    for fine in (16, 1):  # with one square a leaf its features say little, and points have to settle the links
        got = {(r["run"], r["cell"]): r["head"] for r in linked_sets(df, "run", "cell", "u", "v", 0.3, 5, fine).collect()}
        assert got == brute(rows, 0.3, 5)


def test_sets_cross_subtrees(spark):
    rows = [("A", f"c{i:03d}", 0.29 * i - 20, 0.01 * (i % 7)) for i in range(140)] + [("A", f"d{i:02d}", 30.0, 0.1 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "run string, cell string, u double, v double")
    assert {r["cell"]: r["head"] for r in linked_sets(df, "run", "cell", "u", "v", 0.3, 5).collect()} == {f"c{i:03d}": "c000" for i in range(140)}


def test_linked_sets_of_nothing(spark):
    df = spark.createDataFrame([], "run string, cell string, u double, v double")
    assert linked_sets(df, "run", "cell", "u", "v", 0.3, 5).count() == 0


def test_features_merge_whatever_the_partitions(spark):
    g = np.random.default_rng(2)
    df = spark.createDataFrame([("A", f"c{i}", float(a), float(b)) for i, (a, b) in enumerate(np.round(g.normal(size=(200, 2)) * 8) / 8)], "run string, cell string, u double, v double")
    one, many = (sorted(map(tuple, leaf_features(plane_points(df.repartition(k), "run", "cell", "u", "v"), 0.5).collect())) for k in (1, 7))
    assert one == many


def test_ward_separates_blobs(spark):
    g = np.random.default_rng(3)
    m = np.concatenate([g.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    assert len(set(ward(np.ones(180), m, 3)[:60])) == 1
    df = spark.createDataFrame([("A", f"c{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(m)] + [("A", "none", None, 1.0)], "run string, cell string, u double, v double")
    got = ward_clusters(df, "run", "cell", "u", "v", clusters=3, most_leaves=64)
    label = {r["cell"]: r["cluster_no"] for r in got.collect()}
    assert len(label) == 180 and all(len({label[f"c{i:03d}"] for i in range(k, k + 60)}) == 1 for k in (0, 60, 120))
    d = {r["cluster_no"]: r for r in describe_clusters(got, "run", "cell").collect()}
    assert all(r["size"] == 60 and len(r["typical"]) == 3 for r in d.values()) and len(d) == 3
    far = {r["cell"]: r["distance"] for r in got.collect()}
    assert all(far[r["typical"][0]] <= far[r["typical"][1]] <= far[r["typical"][2]] for r in d.values())


def agreement(a, b):
    two = lambda c: sum(n * (n - 1) / 2 for n in c.values())
    both, one, other, n = two(collections.Counter(zip(a, b))), two(collections.Counter(a)), two(collections.Counter(b)), len(a) * (len(a) - 1) / 2
    return (both - one * other / n) / ((one + other) / 2 - one * other / n)


@pytest.mark.parametrize("far", [False, True])
def test_summaries_give_nearly_the_clusters_of_exact_ward(spark, far):
    g = np.random.default_rng(9)
    m = np.concatenate([g.normal(c, s, (k, 2)) for c, s, k in (((0, 0), 0.5, 300), ((4, 1), 0.3, 150), ((1, 5), 0.8, 200), ((-4, 3), 0.2, 50), ((5, -4), 0.6, 100))])
    if far:
        m = np.concatenate([m, [[300.0, 300.0]]])  # one far point must not blur the rest
    df = spark.createDataFrame([("A", f"c{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(m)], "run string, cell string, u double, v double")
    k = 5 + far
    exact = ward(np.ones(len(m)), m, k)
    got = {r["cell"]: r["cluster_no"] for r in ward_clusters(df, "run", "cell", "u", "v", clusters=k, most_leaves=96).collect()}
    assert agreement(list(exact), [got[f"c{i:04d}"] for i in range(len(m))]) > 0.95
