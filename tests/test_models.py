"""Simulated data with a known answer, brute force and round trips."""

import gzip
import math
from pathlib import Path

import numpy as np

from spotweave.operators import bayes, factor, raster
from spotweave.operators.clusters import separability, silhouettes
from spotweave.operators.community import communities, modularity
from spotweave.operators.knn import knn_plane
from spotweave.operators.markers import adjust_bh, significant, two_sided_p
from spotweave.sources.roles import read_molecules, read_vectors, resolve
from spotweave.sources.sinks import write_assignment_record, write_bundle, write_csv_tables, write_json_record, write_matrix_market, write_snapshot, write_tables, write_wide_csv
from spotweave.streaming.counts import stream_counts


def discs(spark, centres, radius, size=200):
    px = [("A", y, x, f"n{k}") for k, (a, b) in enumerate(centres) for y in range(size) for x in range(size) if (y - a) ** 2 + (x - b) ** 2 <= radius * radius]
    return spark.createDataFrame(px, "run string, y int, x int, label string")


def test_expansion_keeps_three_cells_apart(spark):
    p = discs(spark, [(60, 60), (60, 95), (130, 100)], 8)
    e = raster.expand_labels(p, ["run"], "label", 25, 200, 200)
    got = {(r["y"], r["x"]): r["label"] for r in e.collect()}
    assert len(got) == e.count() and set(got.values()) == {"n0", "n1", "n2"}
    assert raster.overlap_fraction(e, ["run"], "label").first()["overlap"] == 0
    seeds = [(r["y"], r["x"], r["label"]) for r in p.collect()]
    m = np.array([(y, x) for y, x, _ in seeds])
    for y, x in [(60, 77), (60, 78), (90, 90), (35, 60), (0, 0), (60, 40)]:
        d = ((m - (y, x)) ** 2).sum(1)
        near = min((int(v), seeds[i][2]) for i, v in enumerate(d))
        assert got.get((y, x)) == (near[1] if near[0] <= 625 else None)


def test_repair_fills_holes_and_drops_crumbs(spark):
    px = [("A", y, x, "a") for y in range(10) for x in range(10) if (y, x) != (5, 5)] + [("A", 40, 40, "a"), ("A", 80, 80, "b")]
    out = raster.repair_geometry(spark.createDataFrame(px, "run string, y int, x int, label string"), ["run"], "label", 20, 500).collect()
    assert len(out) == 100 and {r["label_no"] for r in out} == {1} and (5, 5) in {(r["y"], r["x"]) for r in out}


def test_region_shape(spark):
    px = [("A", y, x, "bar") for y in range(2) for x in range(40)]
    r = raster.region_properties(spark.createDataFrame(px, "run string, y int, x int, label string"), ["run"], "label").first()
    assert r["area"] == 80 and r["extent"] == 1 and abs(r["major"] - 4 * math.sqrt(1600 / 12)) < 1e-9 and r["eccentricity"] > 0.99


def test_silhouette_equals_brute_force(spark):
    g = np.random.default_rng(4)
    pts = [(f"p{i}", ["a", "b", "c"][i % 3], [float(v) for v in g.normal(i % 3, 0.7, 3)]) for i in range(90)] + [("alone", "d", [9.0, 9.0, 9.0])]
    got = {r["id"]: r["silhouette"] for r in silhouettes(spark.createDataFrame(pts, "id string, label string, v array<double>").selectExpr("1 as run", "*"), ["run"], "id", "label", "v").collect()}
    m, l = np.array([p[2] for p in pts]), np.array([p[1] for p in pts])
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    for i, (name, own, _) in enumerate(pts):
        if (l == own).sum() == 1:
            assert got[name] == 0
            continue
        a, b = d[i, l == own].sum() / ((l == own).sum() - 1), min(d[i, l == o].mean() for o in set(l) - {own})
        assert abs(got[name] - (b - a) / max(a, b)) < 1e-9


def test_silhouettes_and_separability_keep_every_point(spark):
    t = spark.range(10_050).selectExpr("1 as run", "concat('p', id) as id", "concat('l', id % 3) as label", "array(id % 3 + (id * 37 % 101) / 100D, (id * 53 % 97) / 100D) as v")
    got = {r["id"]: r["silhouette"] for r in silhouettes(t, ["run"], "id", "label", "v", block=700, chunk=4).collect()}
    assert len(got) == 10_050
    rows = t.collect()
    m, l = np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows])
    for r in rows[::500]:
        d, own = np.sqrt(((m - np.array(r["v"])) ** 2).sum(-1)), l == r["label"]
        a, b = d[own].sum() / (own.sum() - 1), min(d[l == o].mean() for o in set(l) - {r["label"]})
        assert abs(got[r["id"]] - (b - a) / max(a, b)) < 1e-9
    assert {r["label"]: r["n"] for r in separability(t, ["run"], "id", "label", "v").collect()} == {"l0": 3350, "l1": 3350, "l2": 3350}


def test_pca_equals_numpy(spark):
    m = np.random.default_rng(0).normal(size=(60, 5)) * [5, 3, 1, 1, 1] + 2
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(m)], "id long, v array<double>").repartition(4)
    scores, values = factor.vector_pca(df, "id", "v", 3)
    got = np.array([r["scores"] for r in scores.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :3])) and np.allclose(values, s[:3] ** 2 / 59)
    n = spark.createDataFrame([("A", f"c{i:02d}", f"g{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "run string, cell string, gene string, x double")
    got = np.array([r["scores"] for r in factor.count_pca(n, ["run"], "cell", "gene", "x", n.select("run", "gene").distinct(), 3).orderBy("cell").collect()])
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :3]))


def test_weighted_pca_standardises_and_uses_every_gene_and_cell(spark):
    g = np.random.default_rng(6)
    m = g.poisson(0.8, size=(130, 70)) * g.uniform(0.1, 9, size=70)
    m[5] = 0
    m[5, 69] = 2.0  # a cell with nothing but the gene that has no posterior
    p = g.uniform(size=69)
    n = spark.createDataFrame([("A", f"c{i:03d}", f"g{j:02d}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v], "run string, cell string, gene string, x double")
    post = spark.createDataFrame([("A", f"g{j:02d}", float(v)) for j, v in enumerate(p)], "run string, gene string, posterior double")
    z = bayes.weighted_features(bayes.scaled_features(n, ["run"], "cell", "gene", "x"), post, ["run"], "gene")
    w = (m[:, :69] - m[:, :69].mean(0)) / m[:, :69].std(0) * np.sqrt(p)
    u, d, _ = np.linalg.svd(w, full_matrices=False)
    for block in (4096, 40):
        rows = factor.count_pca(z, ["run"], "cell", "gene", "z", post, 50, block).orderBy("cell").collect()
        assert len(rows) == 130 and np.allclose(np.abs([r["scores"] for r in rows]), np.abs((u * d)[:, :50]))


def test_spatial_genes_are_found_and_a_null_is_not(spark):
    g = np.random.default_rng(1)
    xy = g.uniform(size=(300, 2))
    k = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(-1) / (2 * 0.15**2)) + 1e-6 * np.eye(300)
    field = np.linalg.cholesky(k)
    data, truth = [], {}
    for j in range(40):
        truth[f"g{j:02d}"] = j < 12
        y = 3 + (0.8 * field @ g.normal(size=300) + 0.5 * g.normal(size=300) if j < 12 else g.normal(size=300))
        data += [("A", f"c{i:03d}", f"g{j:02d}", float(v)) for i, v in enumerate(y)]
    values = spark.createDataFrame(data, "run string, cell string, gene string, x double")
    cells = spark.createDataFrame([("A", f"c{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(xy)], "run string, cell string, x double, y double")
    edges = knn_plane(cells, ["run"], "cell", "x", "y", 15)
    basis = bayes.spatial_basis(edges, ["run"], 60)
    p = {r["gene"]: (r["posterior"], r["fsv"]) for r in bayes.posteriors(bayes.gene_fits(values, basis, ["run"], "cell", "gene", "x"), ["run"], "gene").collect()}
    right, wrong = [p[x][0] for x in truth if truth[x]], [p[x][0] for x in truth if not truth[x]]
    assert np.mean([a > b for a in right for b in wrong]) > 0.95 and np.mean([p[x][1] for x in truth if truth[x]]) > 0.3
    c = communities(edges, ["run"])
    assert modularity(edges, c, ["run"]).first()["modularity"] > 0.5


def test_iterated_basis_equals_dense_and_keeps_all_cells(spark):
    g = np.random.default_rng(3)
    # Two runs; run B consists of two parts far from each other.
    xy = [("A", f"a{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(g.uniform(size=(400, 2)))]
    xy += [("B", f"b{i:03d}", float(x + 9 * (i % 2)), float(y)) for i, (x, y) in enumerate(g.uniform(size=(300, 2)))]
    edges = knn_plane(spark.createDataFrame(xy, "run string, cell string, x double, y double"), ["run"], "cell", "x", "y", 6)
    for normalise in (True, False):
        want, got = ({(r["run"], r["cell"]): (r["u"], r["gamma"]) for r in bayes.spatial_basis(edges, ["run"], 12, normalise, dense).collect()} for dense in (3000, 120))
        assert want.keys() == got.keys() == {t[:2] for t in xy}
        for run in "AB":
            at = sorted(k for k in want if k[0] == run)
            u, v = np.array([want[k][0] for k in at]), np.array([got[k][0] for k in at])
            assert v.shape == (len(at), 12) and np.allclose(want[at[0]][1], got[at[0]][1], rtol=1e-9)
            assert np.abs(u - v).max() < 1e-4


def test_gene_fits_by_blocks_equal_those_of_the_whole(spark):
    g = np.random.default_rng(8)
    cells = spark.createDataFrame([("A", f"c{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(g.uniform(size=(200, 2)))], "run string, cell string, x double, y double")
    basis = bayes.spatial_basis(knn_plane(cells, ["run"], "cell", "x", "y", 15), ["run"], 20)
    values = spark.createDataFrame([("A", f"c{i:03d}", f"g{j}", float(g.poisson(2) + 1)) for i in range(200) for j in range(6) if (i + j) % 3], "run string, cell string, gene string, x double")
    whole, cut = ({r["gene"]: r["log_bf"] for r in bayes.gene_fits(values, basis, ["run"], "cell", "gene", "x", k).collect()} for k in (4096, 50))
    assert len(whole) == 6 and whole.keys() == cut.keys() and all(abs(whole[x] - cut[x]) < 1e-6 for x in whole)


def test_p_values(spark):
    df = spark.createDataFrame([("g", "a", 0.0), ("g", "b", 3.0), ("g", "c", None)], "k string, gene string, score double").withColumn("pval", two_sided_p("score"))
    r = {x["gene"]: x for x in adjust_bh(df.filter("pval is not null"), ["k"], "pval", "pval_adj", "gene").selectExpr("*", "1.0D as logfoldchange").collect()}
    assert abs(r["a"]["pval"] - 1) < 1e-12 and abs(r["b"]["pval"] - math.erfc(3 / math.sqrt(2))) < 1e-15 and abs(r["b"]["pval_adj"] - 2 * r["b"]["pval"]) < 1e-15
    assert significant(adjust_bh(df.filter("pval is not null"), ["k"], "pval", "pval_adj", "gene").selectExpr("*", "1.0D as logfoldchange")).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    n = spark.createDataFrame([("A", "c1", "g1", 2), ("A", "c2", "g1", 1), ("A", "c2", "g2", 5)], "run string, cell string, gene string, n long")
    write_matrix_market(n, "cell", "gene", f"{tmp_path}/mm")
    lines = sorted(line for f in Path(f"{tmp_path}/mm/matrix").glob("*.gz") for line in gzip.open(f, "rt").read().split("\n") if line)
    assert lines == ["1 1 2", "1 2 1", "2 2 5"] and "2 2 3" in next(Path(f"{tmp_path}/mm/header").glob("part*")).read_text()
    write_wide_csv(n, ["run"], "cell", "gene", ["g1", "g2"], f"{tmp_path}/wide")
    back = {r["cell"]: (r["g1"], r["g2"]) for r in spark.read.csv(f"{tmp_path}/wide", header=True).collect()}
    assert back == {"c1": ("2", "0"), "c2": ("1", "5")}
    write_json_record(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/json")
    assert spark.read.text(f"{tmp_path}/json").first()[0] == '{"a":1,"b":null}'
    write_bundle(n, n.select("cell").distinct(), "cell", "gene", f"{tmp_path}/bundle", {"pca": (spark.createDataFrame([("c1", [1.0, 2.0]), ("c2", [3.0])], "cell string, v array<double>"), "v", "PC_")})
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/bundle/pca", header=True).select("cell", "PC_1", "PC_2").collect()} == {("c1", "1.0", "2.0"), ("c2", "3.0", None)}
    assert spark.read.csv(f"{tmp_path}/bundle/metadata", header=True).count() == 2
    write_tables({"n": n}, f"{tmp_path}/set")
    write_csv_tables({"n": n}, f"{tmp_path}/csv")
    assert spark.read.parquet(f"{tmp_path}/set/n").count() == spark.read.csv(f"{tmp_path}/csv/n", header=True).count() == 3
    write_assignment_record(spark.createDataFrame([("A", 0, 5, 4, 2, True), ("A", 1, 1, 1, 1, False)], "run string, mapping int, n_valid long, n_assigned long, n_cells long, best boolean"), ["run"], f"{tmp_path}/record")
    assert spark.read.text(f"{tmp_path}/record").first()[0] == '{"run":"A","mapping":0,"n_valid":5,"n_assigned":4,"n_cells":2}'
    write_snapshot({"t": n}, str(tmp_path), "final")
    assert spark.read.csv(f"{tmp_path}/t_final", header=True).count() == 3
    spark.createDataFrame([(1.0, 2.0, "g", "e"), (None, 2.0, "g", "e")], "x_location double, y double, target string, more string").write.parquet(f"{tmp_path}/m")
    assert [tuple(r) for r in read_molecules(spark, f"{tmp_path}/m").collect()] == [(1.0, 2.0, "g")]
    assert resolve(["x", "x_location"], "x") == "x"
    spark.createDataFrame([("c", 1.0, 2.0)], "cell string, `PC.1` double, PC_2 double").write.option("header", True).csv(f"{tmp_path}/v")
    assert read_vectors(spark, f"{tmp_path}/v", "cell").first()["v"] == [1.0, 2.0]


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    from datetime import datetime

    rows = [(i % 40, "r", f"c{i % 3}", "g" if i % 2 else " G ", datetime(2024, 1, 1 + (i % 40) % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "transcript_id long, run_id string, cell_id string, feature_name string, loaded_at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    q = stream_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from streamed").first()[0] == 40


def test_repair_takes_the_largest_part_of_any_label_and_solidity(spark):
    far = [("A", 2 * y, 3 * x, "scattered") for y in range(40) for x in range(0, 40, 2)]  # many crumbs, over the bound together
    solid = [("A", 100 + y, 100 + x, "scattered") for y in range(6) for x in range(6)]
    star = [("A", 300 + i, 300, "star") for i in range(31)] + [("A", 315, 285 + i, "star") for i in range(31)]
    df = spark.createDataFrame(far + solid + star, "run string, y int, x int, label string").distinct()
    out = raster.repair_geometry(df, ["run"], "label", 10, 100).collect()
    assert {r["label_no"] for r in out} == {1, 2} and sum(r["label_no"] == 1 for r in out) == 36
    assert {r["label_no"] for r in raster.repair_geometry(df, ["run"], "label", 10, 100, min_solidity=0.5).collect()} == {1}
    shape = {r["label"]: r for r in raster.shape_statistics(spark.createDataFrame(solid + star, df.schema), ["run"], "label").collect()}
    assert shape["scattered"]["solidity"] == 1 and shape["scattered"]["perimeter"] == 20 and shape["star"]["solidity"] < 0.2


def test_merging_ends_and_equals_brute_force(spark):
    from spotweave.operators.clusters import merge_indistinct

    g = np.random.default_rng(5)
    pts = [("A", f"c{k}", [float(v) for v in g.normal((3 * (k // 2), 0), 0.5)]) for k in range(6) for _ in range(25)]
    got = {r["label"]: r["merged"] for r in merge_indistinct(spark.createDataFrame(pts, "run string, label string, v array<double>"), ["run"], "label", "v", 1.0).collect()}
    names, m = np.array([p[1] for p in pts]), np.array([p[2] for p in pts])
    while True:
        ls = sorted(set(names))
        c = {l: m[names == l].mean(0) for l in ls}
        r = {l: np.sqrt(((m[names == l] - c[l]) ** 2).sum(1)).mean() for l in ls}
        sep, a, b = min((round(float(np.sqrt(((c[a] - c[b]) ** 2).sum()) / (r[a] + r[b] + 1e-9)), 9), a, b) for a in ls for b in ls if a < b)
        if sep >= 1.0 or len(ls) <= 2:
            break
        names[names == b] = a
    assert got == dict(zip([p[1] for p in pts], names))


def test_resolutions_are_swept_and_one_is_chosen(spark):
    from spotweave.operators.community import choose_resolution

    g = np.random.default_rng(2)
    m = np.concatenate([g.normal(c, 0.3, (40, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4))])
    df = spark.createDataFrame([("A", f"p{i:03d}", float(a), float(b), [float(a), float(b)]) for i, (a, b) in enumerate(m)], "run string, id string, x double, y double, v array<double>")
    found = communities(knn_plane(df, ["run"], "id", "x", "y", 10), ["run"], resolutions=[0.5, 1.0])
    t = choose_resolution(found, df, ["run"], "id", "v").collect()
    assert sum(r["chosen"] for r in t) == 1 and next(r for r in t if r["chosen"])["n_communities"] == 4
