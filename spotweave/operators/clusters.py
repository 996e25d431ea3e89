"""Statistics of labelled points: centroids, radii, silhouettes, agreement, merging, spatial refinement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.stats import entropy, softmax, squared_distance
from spotweave.operators.skew import exact_quantile, mean_ranks, number_rows, running_sum
from spotweave.session import checkpoint


def vector_means(points: DataFrame, groups: list[str], v: str) -> DataFrame:
    """(groups, n, centre): mean vector of each group."""
    m = points.select(*groups, F.posexplode(v).alias("i", "x")).groupBy(*groups, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(*groups).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def cluster_radii(points: DataFrame, by: list[str], label: str, v: str) -> DataFrame:
    """(by, label, n, radius): mean Euclidean distance to the centroid; 0 for one point."""
    g = [*by, label]
    d = points.join(vector_means(points, g, v).select(*g, "centre"), g)
    return d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg(F.sqrt(squared_distance(F.col(v), F.col("centre")))).alias("radius"))


def centre_distances(points: DataFrame, by: list[str], label: str, v: str) -> DataFrame:
    """(by, a, b, distance) between all centroids of a dataset; there are as many as labels, not points."""
    c = vector_means(points, [*by, label], v)
    a, b = (c.select(*by, F.col(label).alias(k), F.col("centre").alias(f"c{k}")) for k in ("a", "b"))
    return a.join(b, by).filter("a <> b").select(*by, "a", "b", F.sqrt(squared_distance(F.col("ca"), F.col("cb"))).alias("distance"))


def silhouettes(points: DataFrame, by: list[str], id_: str, label: str, v: str, block: int = 4096, chunk: int = 8) -> DataFrame:
    """(by, id_, label, silhouette) by Euclidean distance, exact among all points of a dataset.

    A dataset's points are cut into blocks of about ``block``. A task compares one block with ``chunk`` blocks and gives each point's sum of distances
    and count for each label, no pairs; these are added up by block. The work grows with the square of a dataset's points. A point alone in its
    cluster has 0; a dataset with one label has null.
    """
    p = points.select(*by, F.col(id_).alias("id"), F.col(label).cast("string").alias("label"), F.col(v).cast("array<double>").alias("v")).filter("label is not null and v is not null")
    blocks = p.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    t = p.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", F.floor(F.col("block") / chunk).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label", kind="stable")
        names, size = np.unique(pdf["label"].to_numpy(dtype=str), return_counts=True)
        m = np.stack(pdf["v"].to_numpy()).astype(float)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in [*by, "blocks", "part"]}, "names": [names.tolist()], "size": [size.tolist()], "d": [m.shape[1]], "v": [m.tobytes()]})

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_numpy()).astype(float)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in [*by, "blocks", "block"]}, "ids": [pdf["id"].tolist()], "own": [pdf["label"].tolist()], "v": [m.tobytes()]})

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*by, "block", "names", "size", "total"])
        r = right.iloc[0]
        q, m = (np.frombuffer(x).reshape(-1, r["d"]) for x in (left["v"].iloc[0], r["v"]))
        first, m = np.concatenate(([0], np.cumsum(r["size"])[:-1])), np.ascontiguousarray(m.T)
        total = np.stack([np.add.reduceat(np.sqrt(((m - row[:, None]) ** 2).sum(0)), first) for row in q])
        return left[[*by, "block"]].assign(names=[r["names"]], size=[r["size"]], total=[total.tobytes()])

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, label = left["ids"].iloc[0], np.asarray(left["own"].iloc[0], dtype=str)
        names = np.unique(np.concatenate([np.asarray(x, dtype=str) for x in right["names"]]))
        size, total = np.zeros(len(names)), np.zeros((len(label), len(names)))
        for n, k, x in zip(right["names"], right["size"], right["total"]):
            i = np.searchsorted(names, np.asarray(n, dtype=str))
            size[i] += k
            total[:, i] += np.frombuffer(x).reshape(len(label), -1)
        own, at = np.searchsorted(names, label), np.arange(len(label))
        with np.errstate(divide="ignore", invalid="ignore"):
            a = total[at, own] / (size[own] - 1)
            mean = total / size
            mean[at, own] = np.inf
            b = mean.min(1)
            top = np.maximum(a, b)
            s = np.where(size[own] == 1, 0.0, np.where(top > 0, (b - a) / top, 0.0))
        if len(names) < 2:
            s = np.full(len(label), np.nan)
        return pd.DataFrame({**{c: left[c].iloc[0] for c in by}, "id": ids, "label": label, "silhouette": s})

    held = t.groupBy(*by, "block").applyInPandas(hold, f"{keys}, blocks int, block int, ids array<{kinds['id']}>, own array<string>, v binary")
    right = t.groupBy(*by, "part").applyInPandas(pack, f"{keys}, blocks int, part int, names array<string>, size array<long>, d int, v binary")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / chunk).cast("int")))).select(*by, "block", "part", "v")
    sums = mine.groupBy(*by, "block", "part").cogroup(right.groupBy(*by, "block", "part")).applyInPandas(compare, f"{keys}, block int, names array<string>, size array<long>, total binary")
    schema = f"{keys}, id {kinds['id']}, label string, silhouette double"
    out = held.select(*by, "block", "ids", "own").groupBy(*by, "block").cogroup(sums.groupBy(*by, "block")).applyInPandas(finish, schema)
    return out.withColumn("silhouette", F.when(~F.isnan("silhouette"), F.col("silhouette"))).withColumnsRenamed({"id": id_, "label": label})


def separability(points: DataFrame, by: list[str], id_: str, label: str, v: str) -> DataFrame:
    """(by, label, n, mean_silhouette, nearest_cluster, centroid_dist)."""
    s = silhouettes(points, by, id_, label, v).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("mean_silhouette"))
    near = centre_distances(points, by, label, v).groupBy(*by, F.col("a").alias(label)).agg(F.min(F.struct("distance", "b")).alias("m"))
    return s.join(near, [*by, label], "left").select(*by, label, "n", "mean_silhouette", F.col("m.b").alias("nearest_cluster"), F.col("m.distance").alias("centroid_dist"))


def merge_indistinct(points: DataFrame, by: list[str], label: str, v: str, threshold: float, min_clusters: int = 2) -> DataFrame:
    """(by, label, merged): labels merged while the closest pair's separation, distance / (radius + radius + 1e-9), is below ``threshold``.

    Each round every dataset merges its worst pair into the smaller label; centroids are merged from their sums, and only the points of a merged pair are
    read for its radius. It ends when no dataset has a pair to merge, after at most as many rounds as a dataset has labels.
    """
    p = points.select(*by, F.col(label).alias("__l"), F.col(v).alias("__v"))
    state = vector_means(p, [*by, "__l"], "__v").join(cluster_radii(p, by, "__l", "__v").select(*by, "__l", "radius"), [*by, "__l"])
    state = checkpoint(state.withColumnRenamed("__l", "merged"))
    names = checkpoint(state.select(*by, F.col("merged").alias("__l"), "merged"))
    while True:
        a, b = (state.select(*by, F.struct("merged", "n", "centre", "radius").alias(k)) for k in "ab")
        k = state.groupBy(*by).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > min_clusters).select(*by)
        sep = F.sqrt(squared_distance(F.col("a.centre"), F.col("b.centre"))) / (F.col("a.radius") + F.col("b.radius") + 1e-9)
        worst = a.join(k, by).join(b, by).filter("a.merged < b.merged").groupBy(*by).agg(F.min(F.struct(F.round(sep, 9).alias("sep"), "a", "b")).alias("m")).filter(F.col("m.sep") < threshold)
        total = F.col("m.a.n") + F.col("m.b.n")
        centre = F.zip_with("m.a.centre", "m.b.centre", lambda x, y: (x * F.col("m.a.n") + y * F.col("m.b.n")) / total)
        worst = checkpoint(worst.select(*by, F.col("m.a.merged").alias("keep"), F.col("m.b.merged").alias("gone"), total.alias("n"), centre.alias("centre")))
        if worst.isEmpty():
            return names.withColumnRenamed("__l", label)
        names = checkpoint(names.join(worst.select(*by, "keep", "gone"), by, "left").withColumn("merged", F.when(F.col("merged") == F.col("gone"), F.col("keep")).otherwise(F.col("merged"))).select(*by, "__l", "merged"))
        touched = names.join(worst, by).filter("merged = keep").select(*by, "__l", "keep", "n", "centre")
        new = p.join(touched, [*by, "__l"]).groupBy(*by, F.col("keep").alias("merged")).agg(F.max("n").alias("n"), F.max("centre").alias("centre"), F.avg(F.sqrt(squared_distance(F.col("__v"), F.col("centre")))).alias("radius"))
        ends = worst.select(*by, F.explode(F.array("keep", "gone")).alias("merged"))
        state = checkpoint(state.join(ends, [*by, "merged"], "left_anti").select(*by, "merged", "n", "centre", "radius").unionByName(new))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, ari): the adjusted Rand index of two labelings, from the contingency table."""
    t = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda c: F.sum(c * (c - 1) / 2)
    n = F.col("n")
    cells = t.agg(two(n).alias("ij"), F.sum("n").alias("total"))
    ra = t.groupBy("a").agg(F.sum("n").alias("n")).agg(two(n).alias("ai"))
    rb = t.groupBy("b").agg(F.sum("n").alias("n")).agg(two(n).alias("bj"))
    one = cells.withColumn("k", F.lit(1)).join(ra.withColumn("k", F.lit(1)), "k").join(rb.withColumn("k", F.lit(1)), "k")
    expected = F.col("ai") * F.col("bj") / (F.col("total") * (F.col("total") - 1) / 2)
    return one.select(F.col("total").cast("long").alias("n"), ((F.col("ij") - expected) / ((F.col("ai") + F.col("bj")) / 2 - expected)).alias("ari"))


def label_changes(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """(by, n, n_changed, share_changed, clusters_before, clusters_after)."""
    changed = F.sum((~F.col(before).eqNullSafe(F.col(after))).cast("long"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), changed.alias("n_changed"), (changed / F.count(F.lit(1))).alias("share_changed"), F.countDistinct(before).alias("clusters_before"), F.countDistinct(after).alias("clusters_after"))


def small_to_noise(df: DataFrame, by: list[str], label: str, least: int = 25) -> DataFrame:
    """Labels of fewer than ``least`` points become ``noise``."""
    small = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < least).select(*by, label, F.lit(True).alias("__small"))
    return df.join(small, [*by, label], "left").withColumn(label, F.when(F.col("__small"), F.lit("noise")).otherwise(F.col(label))).select(*df.columns)


def set_overlap(a: DataFrame, b: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, n_a, n_b, delta, jaccard) of two sets of keys for each group, delta = n_b - n_a; a group that both sets lack has no row, one that only one has gives 0."""
    x = a.select(*by, key).distinct().withColumn("__a", F.lit(1)).join(b.select(*by, key).distinct().withColumn("__b", F.lit(1)), [*by, key], "full")
    return x.groupBy(*by).agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), (F.count("__b") - F.count("__a")).alias("delta"), (F.sum(F.col("__a") * F.col("__b")) / F.count(F.lit(1))).alias("jaccard")).na.fill(0.0, ["jaccard"])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, rho): rank correlation with average ties. Ranks come from counts of values over range partitions, so no task holds a group."""
    r = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("__a"), F.col(b).alias("__b"))
    for c in ("__a", "__b"):
        r = r.join(mean_ranks(r, by, c, f"__r{c}").drop("n"), [*by, c])
    return r.groupBy(*by).agg(F.corr("__r__a", "__r__b").alias("rho"))


def roc(df: DataFrame, by: list[str], score: str, truth: str, key: str) -> DataFrame:
    """(by, auc): area under the curve of descending scores by trapezoids, without grouping ties (ties follow ``key``). Running sums are split over range partitions."""
    d = df.select(*by, (-F.col(score)).alias("__s"), F.col(key).alias("__key"), F.col(truth).cast("long").alias("__t"))
    d = running_sum(d, by, ["__s", "__key"], "__t", "__tp")
    p, n = F.sum("__t"), F.sum(1 - F.col("__t"))
    return d.groupBy(*by).agg((F.sum((1 - F.col("__t")) * F.col("__tp")) / (p * n)).alias("auc"))


def detection_quality(df: DataFrame, by: list[str], chosen: str, truth: str) -> DataFrame:
    """(by, n_selected, n_true, precision, recall) of a boolean choice against a boolean truth; null where nothing is selected or true."""
    hit = F.sum((F.col(chosen) & F.col(truth)).cast("long"))
    n, t = F.sum(F.col(chosen).cast("long")), F.sum(F.col(truth).cast("long"))
    return df.groupBy(*by).agg(n.alias("n_selected"), t.alias("n_true"), (hit / F.nullif(n, F.lit(0))).alias("precision"), (hit / F.nullif(t, F.lit(0))).alias("recall"))


def root_mean_square(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, rmse) of two columns, over rows that have both."""
    d = F.col(a) - F.col(b)
    return df.filter(d.isNotNull() & ~F.isnan(d)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"))


def recode(df: DataFrame, label: str, mapping: DataFrame, source: str, target: str, keep: bool = False) -> DataFrame:
    """df with the label replaced by its ``target`` in a small mapping table; a label that is not in it becomes null, or stays if ``keep``."""
    m = mapping.groupBy(F.col(source).alias("__from")).agg(F.min(target).alias("__to"))
    out = df.join(m, df[label] == m["__from"], "left")
    return out.withColumn(label, F.coalesce("__to", label) if keep else F.col("__to")).select(*df.columns)


def margins(points: DataFrame, by: list[str], id_: str, label: str, v: str, quantile: float = 0.35) -> DataFrame:
    """(by, id_, label, own, second, margin, boundary): distance to the own centroid, the second smallest to any, their difference, and whether it is below the dataset's quantile.

    In a dataset with one label there is no second.
    """
    c = vector_means(points, [*by, label], v).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "centre"))).alias("c"))
    t = points.join(c, by).withColumn("__d", F.transform("c", lambda s: F.sqrt(squared_distance(F.col(v), s["centre"]))))
    own = F.get("__d", (F.array_position(F.transform("c", lambda s: s["l"]), F.col(label)) - 1).cast("int"))
    t = t.select(*by, id_, label, own.alias("own"), F.get(F.array_sort("__d"), F.lit(1)).alias("second")).withColumn("margin", F.col("second") - F.col("own"))
    cut = exact_quantile(t, by, "margin", quantile, "__cut")
    return t.join(cut, by, "left").withColumn("boundary", F.round("margin", 9) < F.round("__cut", 9)).drop("__cut")


def spatial_posterior(points: DataFrame, edges: DataFrame, by: list[str], id_: str, label: str, v: str, beta: float | None = None) -> DataFrame:
    """(by, id_, label, candidate, confidence, entropy, gain): Bayesian label posterior of each point.

    Log likelihood of a cluster: minus the distance to its centroid. Log prior: ``beta`` times the number of neighbours with its label; by default
    min(1.2, 0.3 + log(1 + K)) for K clusters. One row holds a point's values for all K labels of its dataset as an array, in label order.
    """
    c = vector_means(points, [*by, label], v).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "centre"))).alias("c"))
    near = points.select(*by, F.col(id_).alias("dst"), F.col(label).alias("__l"))
    votes = edges.join(near, [*by, "dst"]).groupBy(*by, F.col("src").alias(id_)).agg(F.collect_list("__l").alias("near"))
    t = points.select(*by, id_, F.col(label).alias("label"), v).join(c, by).join(votes, [*by, id_], "left")
    b = F.lit(beta) if beta is not None else F.least(F.lit(1.2), 0.3 + F.log1p(F.size("c").cast("double")))
    t = t.withColumn("near", F.coalesce("near", F.array().cast("array<string>")))
    logit = F.transform("c", lambda s: -F.sqrt(squared_distance(F.col(v), s["centre"])) + b * F.size(F.filter("near", lambda l: l == s["l"])))
    t = t.withColumn("p", softmax(logit))
    own = F.element_at("p", F.array_position(F.transform("c", lambda s: s["l"]), F.col("label")).cast("int"))
    best = F.array_max("p")
    at = F.array_position(F.transform("p", lambda x: F.round(x, 12)), F.round(best, 12)).cast("int")
    return t.select(*by, id_, "label", F.element_at("c", at)["l"].alias("candidate"), best.alias("confidence"), entropy(F.col("p")).alias("entropy"), (best - own).alias("gain"))


def refine_labels(posterior: DataFrame, by: list[str], id_: str, least: float = 0.6, most: float = 0.5, revert: float = 0.3) -> DataFrame:
    """(by, id_, label, refined): candidates accepted where confidence exceeds ``least``, the gain is positive and the label differs.

    At most ``most`` of a dataset's points change, the most confident first (ties: smaller id). If more than ``revert`` would change, the dataset keeps its labels.
    """
    flag = (F.round("confidence", 9) > least) & (F.round("gain", 9) > 0) & (F.col("candidate") != F.col("label"))
    t = posterior.select(*by, F.col(id_).alias("__id"), "label", "candidate", "confidence", "gain")
    wish = t.filter(flag).select(*by, "__id", (-F.round("confidence", 9)).alias("__o"))
    room = t.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    taken = number_rows(wish, by, ["__o", "__id"], "__r").join(room, by).filter(F.col("__r") <= F.floor(F.col("__n") * most))
    # A dataset that would change too much keeps all its labels.
    sane = taken.groupBy(*by, "__n").agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") / F.col("__n") <= revert).select(*by)
    taken = taken.join(sane, by, "left_semi").select(*by, "__id", F.lit(True).alias("__ok"))
    out = t.join(taken, [*by, "__id"], "left")
    return out.select(*by, F.col("__id").alias(id_), "label", F.when(F.col("__ok"), F.col("candidate")).otherwise(F.col("label")).alias("refined"))


def uncertain_regions(posterior: DataFrame, edges: DataFrame, by: list[str], id_: str, quantile: float = 0.75, budget: float = 0.25) -> DataFrame:
    """(by, region, size, density, selected): connected regions of high-entropy points, chosen by mean entropy / size within a budget.

    Nodes have entropy at or above the quantile; edges join two of them. Regions are taken in order of density, skipping those that would take
    more than ``budget`` of the dataset's points; the greedy walk sees one row for each region.
    """
    t = region_members(posterior, edges, by, id_, quantile)
    r = t.groupBy(*by, "region").agg(F.count(F.lit(1)).alias("size"), (F.avg("entropy") / F.count(F.lit(1))).alias("density"), F.max("total").alias("total"))
    kinds = {f.name: f.dataType.simpleString() for f in r.schema}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=-pdf["density"].round(9)).sort_values(["o", "region"])
        left, out = budget * pdf["total"].iloc[0], []
        for size in pdf["size"]:
            out.append(size <= left)
            left -= size if size <= left else 0
        return pdf.assign(selected=out)[[*by, "region", "size", "density", "selected"]]

    return r.groupBy(*by).applyInPandas(choose, ", ".join([*[f"{c} {kinds[c]}" for c in by], f"region {kinds['region']}", "size long", "density double", "selected boolean"]))


def choose_mode(points: DataFrame, posterior: DataFrame, regions: DataFrame, members: DataFrame, by: list[str], id_: str, label: str, v: str) -> DataFrame:
    """(by, id_, label, refined, mode, in_roi): each dataset's labels refined everywhere or only in the selected regions, whichever scores higher.

    The score is mean silhouette + mean confidence - mean entropy of the labels; the regions win only if they are strictly better. ``posterior`` is that of ``spatial_posterior``,
    ``regions`` (by, region, selected) that of ``uncertain_regions`` and ``members`` (by, id_, region) says which point lies where.
    """
    inside = members.join(regions.filter("selected").select(*by, "region"), [*by, "region"], "left_semi").select(*by, id_, F.lit(True).alias("in_roi"))
    t = refine_labels(posterior, by, id_).join(inside, [*by, id_], "left").withColumn("in_roi", F.coalesce("in_roi", F.lit(False)))
    t = checkpoint(t.withColumn("roi", F.when(F.col("in_roi"), F.col("refined")).otherwise(F.col("label"))))
    certain = posterior.groupBy(*by).agg((F.avg("confidence") - F.avg("entropy")).alias("base"))
    score = certain
    for mode, column in (("all", "refined"), ("some", "roi")):
        s = silhouettes(points.select(*by, id_, v).join(t.select(*by, id_, F.col(column).alias(label)), [*by, id_]), by, id_, label, v)
        score = score.join(s.groupBy(*by).agg(F.avg("silhouette").alias(mode)), by, "left")
    score = score.select(*by, F.when(F.round(F.coalesce("some", F.lit(0.0)), 9) > F.round(F.coalesce("all", F.lit(0.0)), 9), "ROI").otherwise("GLOBAL").alias("mode"))
    return t.join(score, by).select(*by, id_, "label", F.when(F.col("mode") == "ROI", F.col("roi")).otherwise(F.col("refined")).alias("refined"), "mode", "in_roi")


def region_members(posterior: DataFrame, edges: DataFrame, by: list[str], id_: str, quantile: float = 0.75) -> DataFrame:
    """(by, id_, entropy, total, region): the points of high entropy and the connected region each lies in, named by its smallest id."""
    from spotweave.operators.graph import connected_components

    cut = exact_quantile(posterior, by, "entropy", quantile, "cut").join(posterior.groupBy(*by).agg(F.count(F.lit(1)).alias("total")), by)
    hot = checkpoint(posterior.join(cut, by).filter(F.round("entropy", 9) >= F.round("cut", 9)).select(*by, id_, "entropy", "total"))
    node = lambda c: F.struct(*by, F.col(c).alias("id"))
    keys = hot.select(*by, F.col(id_).alias("k"))
    e = edges.join(keys.withColumnRenamed("k", "src"), [*by, "src"], "left_semi").join(keys.withColumnRenamed("k", "dst"), [*by, "dst"], "left_semi")
    comp = connected_components(e.select(node("src").alias("src"), node("dst").alias("dst")))
    return hot.withColumn("node", node(id_)).join(comp, "node", "left").withColumn("region", F.coalesce(F.col("component.id"), F.col(id_))).select(*by, id_, "entropy", "total", "region")
