import numpy as np

from spotweave.operators.community import choose_resolution, communities
from spotweave.operators.knn import knn_plane


def points(spark, sizes, seed=2):
    g = np.random.default_rng(seed)
    rows = [(run, f"p{i:03d}", float(a), float(b)) for run, n in sizes.items() for i, (a, b) in enumerate(g.uniform(size=(n, 2)))]
    return knn_plane(spark.createDataFrame(rows, "run string, id string, x double, y double"), ["run"], "id", "x", "y", 6)


def labels(found):
    return {tuple(r[c] for c in found.columns if c != "community"): r["community"] for r in found.collect()}


def test_small_datasets_take_a_few_jobs(spark):
    edges = points(spark, {"A": 60, "B": 25})
    spark.sparkContext.setJobGroup("small", "")
    got = labels(communities(edges, ["run"], resolutions=[0.5, 1.0, 2.0]))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("small"))
    spark.sparkContext.setJobGroup("other", "")
    assert len(got) == 3 * 85 and jobs < 40


def test_tasks_and_common_rounds_give_the_same(spark):
    edges = points(spark, {"A": 40, "B": 24})
    one, both = (labels(communities(edges, ["run"], resolutions=[0.5, 2.0], whole=k)) for k in (1_000_000, 150))
    assert one == both and len(one) == 128
    alone = labels(communities(edges.filter("run = 'B'"), ["run"], 2.0))
    assert {k: v for (run, r, k), v in one.items() if (run, r) == ("B", 2.0)} == {k: v for (_, k), v in alone.items()}


def test_a_graph_that_halves_keep_in_motion_ends(spark):
    """All but complete: every round many nodes wish to move. With few rounds the ordered moves settle it, alike in a task and in common rounds."""
    edges = spark.createDataFrame([("A", i, j) for i in range(13) for j in range(13) if i != j and (i + j) % 5], "run string, src int, dst int")
    one, both = (labels(communities(edges, ["run"], rounds=1, whole=k)) for k in (1_000_000, 0))
    assert one == both and len(one) == 13


def test_silhouettes_of_all_resolutions_equal_those_by_blocks(spark):
    g = np.random.default_rng(4)
    df = spark.createDataFrame([(run, f"p{i:03d}", [float(x) for x in v]) for run, n in (("A", 50), ("B", 20), ("C", 5)) for i, v in enumerate(g.normal(size=(n, 3)))], "run string, id string, v array<double>")
    some = spark.createDataFrame([(r["run"], x, r["id"], f"c{j % k}") for j, r in enumerate(df.collect()) for x, k in ((0.5, 1), (1.0, 4), (2.0, 9))], "run string, resolution double, node string, community string")
    spark.sparkContext.setJobGroup("chosen", "")
    whole = choose_resolution(some, df, ["run"], "id", "v").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chosen"))
    spark.sparkContext.setJobGroup("other", "")
    parts = choose_resolution(some, df, ["run"], "id", "v", block=10).collect()
    one, two = ({(r["run"], r["resolution"]): (r["n_communities"], r["chosen"], r["silhouette"] and round(r["silhouette"], 9)) for r in t} for t in (whole, parts))
    assert one == two and len(one) == 9 and jobs < 20


def test_features_compare_the_points_once(spark):
    from spotweave.operators.features import combined_features

    g = np.random.default_rng(5)
    df = spark.createDataFrame([("A", f"p{i:02d}", [float(x) for x in v], float(v[0]), float(v[1])) for i, v in enumerate(g.normal(size=(20, 3)))], "run string, id string, v array<double>, x double, y double")
    found = combined_features(df, ["run"], "id", "v", "x", "y", 5)
    assert "FlatMapCoGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 20
