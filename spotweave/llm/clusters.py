"""Similarity clusters from mergeable cluster features.

A cluster feature (CF) of a set of points is (n, sum, sum of squares, bounds); features of two sets add. The CF tree routes by a fixed
hierarchy of squares: a leaf is a square of the finest level that holds points, its parent the square of twice the side. So every
partition builds its own tree, and trees merge by adding equal nodes: a partial aggregate per partition and an exchange of summaries, the
tree reduction. The result depends neither on the order nor on the partitioning of the points.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators.graph import connected_components
from spotweave.session import checkpoint


def plane_points(df: DataFrame, group: str, id_: str, x: str, y: str) -> DataFrame:
    """(grp, id, x, y), each id of a group once, both coordinates present and finite. Differing repeats: the greatest (x, y) holds."""
    ok = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    rows = df.select(F.col(group).alias("grp"), F.col(id_).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.filter("grp is not null and id is not null").filter(ok("x") & ok("y"))
    return rows.groupBy("grp", "id").agg(F.max(F.struct("x", "y")).alias("p")).select("grp", "id", "p.x", "p.y")


def leaf_features(points: DataFrame, side: float) -> DataFrame:
    """The CF of each leaf square: (grp, cx, cy, n, sx, sy, ss, x0, x1, y0, y1, head), head its smallest id."""
    cell = points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    return cell.groupBy("grp", "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("ss"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("id").alias("head"),
    )


TILE = 32


def _apart(a: str, b: str):
    """Squared least and greatest distance between points of two boxes given by columns a.x0.. and b.x0.."""
    near = [F.greatest(F.col(f"{b}.{k}0") - F.col(f"{a}.{k}1"), F.col(f"{a}.{k}0") - F.col(f"{b}.{k}1"), F.lit(0.0)) for k in "xy"]
    far = [F.greatest(F.col(f"{b}.{k}1") - F.col(f"{a}.{k}0"), F.col(f"{a}.{k}1") - F.col(f"{b}.{k}0")) for k in "xy"]
    return near[0] * near[0] + near[1] * near[1], far[0] * far[0] + far[1] * far[1]


def _joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Each of n nodes' smallest linked node, for links (a, b) on top of ``label``."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        open_ = label[a] != label[b]
        if not open_.any():
            break
        np.minimum.at(label, label[a][open_], low[open_])
        np.minimum.at(label, label[b][open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    return label


def _linked_leaves(t: pd.DataFrame, step: float, reach: int) -> tuple[pd.DataFrame, np.ndarray]:
    """(leaves in order with bounds and sums, each leaf's smallest linked leaf of its tile) of whole tiles' features, sorted by tile, leaf and head."""
    cx, cy, x, y = (t[c].to_numpy() for c in ("cx", "cy", "x", "y"))
    new = lambda *columns: np.concatenate(([True], np.any([c[1:] != c[:-1] for c in (t[k].to_numpy() for k in columns)], axis=0)))
    tile = np.cumsum(new("grp", "tx", "ty"))
    start = np.flatnonzero(new("grp", "tx", "ty", "cx", "cy"))
    first = np.append(start, len(cx))
    fold = lambda c, how: how.reduceat(t[c].to_numpy(), start)
    leaf = t[["grp", "cx", "cy", "own", "head"]].iloc[start].assign(n=fold("n", np.add), whole=fold("whole", np.logical_and))
    box = np.stack([fold("x0", np.minimum), fold("x1", np.maximum), fold("y0", np.minimum), fold("y1", np.maximum)])
    leaf["x0"], leaf["x1"], leaf["y0"], leaf["y1"] = box
    width = TILE + 4 * reach
    lx, ly = (c[start] - t[k].to_numpy()[start] * TILE + reach for c, k in ((cx, "tx"), (cy, "ty")))
    key = (tile[start] * width + lx) * width + ly + reach
    label, s2 = np.arange(len(leaf)), step * step
    ahead = sorted(((dx, dy) for dx in range(reach + 1) for dy in range(-reach, reach + 1) if (dx, dy) > (0, 0)), key=lambda d: d[0] ** 2 + d[1] ** 2)
    for dx, dy in ahead:
        at = np.minimum(np.searchsorted(key, key + dx * width + dy), len(key) - 1)
        a = np.flatnonzero(key[at] == key + dx * width + dy)
        b = at[a]
        far = np.maximum(box[1][b] - box[0][a], box[1][a] - box[0][b]) ** 2 + np.maximum(box[3][b] - box[2][a], box[3][a] - box[2][b]) ** 2
        near = np.maximum(np.maximum(box[0][b] - box[1][a], box[0][a] - box[1][b]), 0) ** 2 + np.maximum(np.maximum(box[2][b] - box[3][a], box[2][a] - box[3][b]), 0) ** 2
        label = _joined(len(leaf), a[far <= s2], b[far <= s2], label)
        open_ = (near <= s2) & (label[a] != label[b])
        a, b = a[open_], b[open_]
        na, nb = (first[k + 1] - first[k] for k in (a, b))
        total = np.cumsum(na * nb)
        for lo in np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, 2_000_000), side="right")):
            # Pairs of leaves by the two million pairs of features; pairs that were linked meanwhile drop out.
            hi = max(lo + 1, np.searchsorted(total, (total[lo - 1] if lo else 0) + 2_000_000, side="right"))
            k = np.arange(lo, min(hi, len(a)))
            k = k[label[a[k]] != label[b[k]]]
            if not len(k):
                continue
            many = na[k] * nb[k]
            start = np.concatenate(([0], np.cumsum(many)[:-1]))
            pair = np.repeat(np.arange(len(k)), many)
            inside = np.arange(many.sum()) - start[pair]
            i, j = first[a[k]][pair] + inside // nb[k][pair], first[b[k]][pair] + inside % nb[k][pair]
            hit = np.logical_or.reduceat((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= s2, start)
            label = _joined(len(leaf), a[k][hit], b[k][hit], label)
    return leaf, label


def _close_links(points: DataFrame, leaves: DataFrame, step: float, side: float, fine: int, reach: int) -> DataFrame:
    """(u, v): links between leaves of different parts that only points which the features left out can decide.

    Squares of leaf pairs are halved level by level: a pair of squares is dropped once its bounds are further apart than ``step`` and decided
    once they lie within it, which happens at the latest when a square holds one place. Pairs of leaves that are decided drop out at once.
    """
    s2, bounds = step * step, ["x0", "x1", "y0", "y1"]
    shifts = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if (dx, dy) != (0, 0)])).alias("k")
    one = leaves.filter("not whole").select("grp", F.struct("cx", "cy", "part", *bounds).alias("a"), shifts).select("grp", "a", "k.cx", "k.cy")
    two = leaves.select("grp", "cx", "cy", F.struct("cx", "cy", "part", *bounds).alias("b"))
    pairs = one.join(two, ["grp", "cx", "cy"]).filter((F.col("a.part") != F.col("b.part")) & (_apart("a", "b")[0] <= s2))
    place = lambda k: F.struct("grp", f"{k}.cx", f"{k}.cy")
    pairs = checkpoint(pairs.select("grp", place("a").alias("u"), place("b").alias("v"), F.struct(F.col("a.cx").alias("ix"), F.col("a.cy").alias("iy")).alias("a"), F.struct(F.col("b.cx").alias("ix"), F.col("b.cy").alias("iy")).alias("b")))
    touched = pairs.select(F.explode(F.array("u", "v")).alias("l")).select("l.*").distinct()
    mine = points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)).join(touched, ["grp", "cx", "cy"], "left_semi").select("grp", "x", "y").distinct()
    mine, links, parts = checkpoint(mine), None, fine
    while not pairs.isEmpty():
        size = side / parts
        at = lambda c: F.floor(F.col(c) / size)  # noqa: E731, B023
        square = mine.groupBy("grp", at("x").alias("ix"), at("y").alias("iy")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        up = fine if parts == fine else 2
        square = square.select("grp", F.floor(F.col("ix") / up).alias("px"), F.floor(F.col("iy") / up).alias("py"), F.struct("ix", "iy", *bounds).alias("s"))
        for k in ("a", "b"):
            pairs = pairs.withColumn("px", F.col(f"{k}.ix")).withColumn("py", F.col(f"{k}.iy")).drop(k).join(square.withColumnRenamed("s", k), ["grp", "px", "py"]).drop("px", "py")
        near, far = _apart("a", "b")
        pairs = checkpoint(pairs.withColumn("sure", far <= s2).filter(near <= s2))
        sure = pairs.filter("sure").select("u", "v").distinct()
        links = sure if links is None else links.unionByName(sure)
        pairs = pairs.filter("not sure").drop("sure").join(sure, ["u", "v"], "left_anti")
        parts *= 2
    return links if links is not None else pairs.select("u", "v")


def linked_sets(df: DataFrame, group: str, id_: str, x: str, y: str, step: float, least: int, fine: int = 16) -> DataFrame:
    """(group, id_, head, set_size): sets of a group's points linked by steps of at most ``step``, of at least ``least`` points; head is the smallest id.

    The CF tree's leaves have a diagonal of at most ``step``, so a leaf's points are linked whatever they are. Each leaf is known by the features of at most
    ``fine`` x ``fine`` squares in it, however many points it holds; a subtree of TILE x TILE leaves, with a rim of the leaves around it, is agglomerated in
    one task by the leaves' nearest members (where Ward's criterion would join by spread). Parts of different subtrees are tied where they share a leaf,
    which leaves a graph of parts for ``connected_components``. Leaf pairs that the features leave open are settled by ``_close_links``. One assignment pass gives each point its leaf's set.
    Coordinates that are null, NaN or infinite have no set; repeated points count once.
    """
    side, reach = step / math.sqrt(2) * (1 - 1e-9), 2
    p = checkpoint(plane_points(df, group, id_, x, y))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    at = lambda c, s: F.floor(F.col(c) / s)
    features = p.groupBy("grp", at("x", side / fine).alias("fx"), at("y", side / fine).alias("fy")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("head"), F.min(F.struct("x", "y")).alias("p"), F.max(F.struct("x", "y")).alias("q"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    features = features.select("grp", F.floor(F.col("fx") / fine).alias("cx"), F.floor(F.col("fy") / fine).alias("cy"), "n", "head", F.col("p.x").alias("x"), F.col("p.y").alias("y"), (F.col("p") == F.col("q")).alias("whole"), "x0", "x1", "y0", "y1")
    tile = lambda c, d=0: F.floor((F.col(c) + d) / TILE)
    tiles = F.array_distinct(F.array(*[F.struct(tile("cx", dx).alias("tx"), tile("cy", dy).alias("ty")) for dx in (0, -reach, reach) for dy in (0, -reach, reach)]))
    rimmed = features.withColumn("t", F.explode(tiles)).select("grp", "t.tx", "t.ty", ((F.col("t.tx") == tile("cx")) & (F.col("t.ty") == tile("cy"))).alias("own"), "cx", "cy", "n", "head", "x", "y", "whole", "x0", "x1", "y0", "y1")

    columns = ["grp", "cx", "cy", "own", "rx", "ry", "n", "head", "x0", "x1", "y0", "y1", "whole"]

    def linked(t: pd.DataFrame) -> pd.DataFrame:
        leaf, label = _linked_leaves(t, step, reach)
        leaf["rx"], leaf["ry"] = leaf["cx"].to_numpy()[label], leaf["cy"].to_numpy()[label]
        inside = np.zeros(len(leaf), dtype=bool)
        inside[label[leaf["own"].to_numpy()]] = True
        return leaf[inside[label]][columns]

    def agglomerate(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(held) < 50_000:
                continue
            last = (held[["tx", "ty"]] == held[["tx", "ty"]].iloc[-1]).all(axis=1) & (held["grp"] == held["grp"].iloc[-1])
            if not last.all():  # the last tile may go on
                yield linked(held[~last])
                held = held[last]
        if held is not None and len(held):
            yield linked(held)

    tiled = rimmed.repartition("grp", "tx", "ty").sortWithinPartitions("grp", "tx", "ty", "cx", "cy", "head")
    leaves = checkpoint(tiled.mapInPandas(agglomerate, f"grp {kinds['grp']}, cx long, cy long, own boolean, rx long, ry long, n long, head {kinds['id']}, x0 double, x1 double, y0 double, y1 double, whole boolean"))
    part = F.struct("grp", F.col("rx").alias("cx"), F.col("ry").alias("cy"))
    own = leaves.filter("own").withColumn("part", part).select("grp", "cx", "cy", "part", "n", "head", "x0", "x1", "y0", "y1", "whole")
    ties = leaves.filter("not own").select("grp", "cx", "cy", part.alias("u")).join(own.select("grp", "cx", "cy", F.col("part").alias("v")), ["grp", "cx", "cy"]).select("u", "v").filter("u <> v")
    comp = connected_components(ties, "u", "v").withColumnsRenamed({"node": "part", "component": "whole_part"})
    own = own.join(comp, "part", "left").withColumn("part", F.coalesce("whole_part", "part")).drop("whole_part")
    if not leaves.filter("own and not whole").isEmpty():
        own = checkpoint(own)
        spot = own.select(F.struct("grp", "cx", "cy").alias("l"), "part")
        more = _close_links(p, own, step, side, fine, reach)
        more = more.join(spot.toDF("u", "pu"), "u").join(spot.toDF("v", "pv"), "v")
        comp = connected_components(more, "pu", "pv").withColumnsRenamed({"node": "part", "component": "whole_part"})
        own = own.join(comp, "part", "left").withColumn("part", F.coalesce("whole_part", "part")).drop("whole_part")
    own = checkpoint(own.select("grp", "cx", "cy", "part", "n", "head"))
    sets = own.groupBy("part").agg(F.sum("n").alias("set_size"), F.min("head").alias("set_head")).filter(F.col("set_size") >= least)
    leaf_of = own.join(sets, "part").select("grp", "cx", "cy", "set_head", "set_size")
    cell = p.withColumn("cx", F.floor(at("x", side / fine) / fine)).withColumn("cy", F.floor(at("y", side / fine) / fine))
    return cell.join(leaf_of, ["grp", "cx", "cy"]).select(F.col("grp").alias(group), F.col("id").alias(id_), F.col("set_head").alias("head"), "set_size")


def ward(n: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Labels 0.. of summaries merged by Ward's criterion until ``k`` are left (ties: the first pair)."""
    n, centre, label = n.astype(float).copy(), centre.astype(float).copy(), np.arange(len(n))
    gap = ((centre[:, None] - centre[None]) ** 2).sum(-1) * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(gap, np.inf)
    for _ in range(max(0, len(n) - k)):
        a, b = sorted(divmod(int(gap.argmin()), len(n)))
        centre[a] = (n[a] * centre[a] + n[b] * centre[b]) / (n[a] + n[b])
        n[a] += n[b]
        n[b] = 0
        label[label == b] = a
        alive = n > 0
        gap[b], gap[:, b] = np.inf, np.inf
        row = ((centre - centre[a]) ** 2).sum(-1) * (n * n[a] / np.maximum(n + n[a], 1e-300))
        row[~alive], row[a] = np.inf, np.inf
        gap[a], gap[:, a] = row, row
    return np.unique(label, return_inverse=True)[1]


def feature_tree(points: DataFrame, depth: int) -> DataFrame:
    """(grp, level, cx, cy, n, sx, sy, sse): every node of each group's CF tree over its bounding square, leaves (level 0) of 1 / 2**depth of its side.

    A level is folded into the next: a parent's feature is the sum of its four children's. ``sse`` is the sum of squared distances to the node's
    centroid. Coordinates are taken from the corner of the square.
    """
    box = points.groupBy("grp").agg(F.min("x").alias("ox"), F.min("y").alias("oy"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-300)).alias("span"))
    p = points.join(box, "grp").select("grp", (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y"), "span", "ox", "oy")
    cell = lambda c: F.least(F.floor(F.col(c) / F.col("span") * 2**depth), F.lit(2**depth - 1)).alias(f"c{c}")
    level = p.groupBy("grp", "ox", "oy", cell("x"), cell("y")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("ss"))
    out = None
    for k in range(depth + 1):
        if k:
            half = lambda c: F.floor(F.col(c) / 2).alias(c)
            level = level.groupBy("grp", "ox", "oy", half("cx"), half("cy")).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "ss")])
        one = level.withColumn("level", F.lit(k))
        out = one if out is None else out.unionByName(one)
    sse = F.when(F.col("n") == 1, 0.0).otherwise(F.greatest(F.col("ss") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / F.col("n"), F.lit(0.0)))
    return checkpoint(out.withColumn("sse", sse))


def fitting_leaves(tree: DataFrame, most: int) -> DataFrame:
    """The nodes of each group's tree cut at the least power of two that leaves at most ``most`` of them: nodes with a smaller sse than it, whose parents have a greater one.

    Raising one bound on the spread until the summary fits is BIRCH's rebuilding; as the bound is on the spread and not on a level, sparse parts keep large
    squares and crowded parts fine ones, so one far point costs the others nothing.
    """
    power = lambda c: F.when(F.col(c) > 1e-250, F.ceil(F.log2(c))).otherwise(-900).cast("int")
    parent = tree.select("grp", F.col("level").alias("pl"), F.col("cx").alias("px"), F.col("cy").alias("py"), power("sse").alias("until"))
    child = tree.withColumn("from", power("sse")).withColumn("pl", F.col("level") + 1).withColumn("px", F.floor(F.col("cx") / 2)).withColumn("py", F.floor(F.col("cy") / 2))
    nodes = child.join(parent, ["grp", "pl", "px", "py"], "left").withColumn("until", F.coalesce("until", F.lit(2000)))
    nodes = nodes.filter(F.col("from") < F.col("until"))
    events = nodes.select("grp", F.explode(F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("d")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy("grp", "e.at").agg(F.sum("e.d").alias("d"))
    alive = events.withColumn("k", F.sum("d").over(Window.partitionBy("grp").orderBy("at"))).filter((F.col("k") <= most) & (F.col("k") > 0))
    bound = alive.groupBy("grp").agg(F.min("at").alias("bound"))
    return nodes.join(bound, "grp").filter((F.col("from") <= F.col("bound")) & (F.col("bound") < F.col("until"))).drop("from", "until", "pl", "px", "py", "bound")


def ward_clusters(df: DataFrame, group: str, id_: str, x: str, y: str, clusters: int = 10, most_leaves: int = 512, depth: int = 12) -> DataFrame:
    """(group, id_, cluster_no, distance): each group's points in at most ``clusters`` clusters of similar ones.

    Each partition adds up its points' cluster features, equal nodes of the partitions' trees are merged in the exchange, and each group's tree is cut
    where at most ``most_leaves`` summaries are left (``fitting_leaves``), so Ward agglomeration, one task a group, sees a bounded summary whatever the group's
    size. One pass over all points assigns each to the nearest cluster centroid: the centroids, at most ``clusters`` for a group, travel as one array.
    Clusters are numbered by size, then centroid. Points with missing coordinates are in no cluster.
    """
    p = checkpoint(plane_points(df, group, id_, x, y))
    chosen = fitting_leaves(feature_tree(p, depth), most_leaves).select("grp", "level", "cx", "cy", "n", (F.col("sx") + F.col("n") * F.col("ox")).alias("sx"), (F.col("sy") + F.col("n") * F.col("oy")).alias("sy"))
    kind = p.schema["grp"].dataType.simpleString()

    def agglomerate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["level", "cx", "cy"])
        label = ward(pdf["n"].to_numpy(), np.stack([pdf["sx"] / pdf["n"], pdf["sy"] / pdf["n"]], 1), clusters)
        s = pdf.assign(label=label).groupby("label")[["n", "sx", "sy"]].sum()
        s["x"], s["y"] = s["sx"] / s["n"], s["sy"] / s["n"]
        s = s.sort_values(["n", "x", "y"], ascending=[False, True, True])
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "xs": [s["x"].tolist()], "ys": [s["y"].tolist()]})

    # Summaries are small but agglomeration takes a while: a stated number of partitions is not coalesced by size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    centres = checkpoint(chosen.repartition(tasks, "grp").groupBy("grp").applyInPandas(agglomerate, f"grp {kind}, xs array<double>, ys array<double>"))
    far = F.zip_with("xs", "ys", lambda a, b: F.sqrt((F.col("x") - a) * (F.col("x") - a) + (F.col("y") - b) * (F.col("y") - b)))
    out = p.join(centres, "grp").withColumn("d", far).withColumn("distance", F.array_min("d"))
    return out.select(F.col("grp").alias(group), F.col("id").alias(id_), F.array_position("d", F.col("distance")).cast("int").alias("cluster_no"), "distance")


def describe_clusters(assigned: DataFrame, group: str, id_: str, members: int = 3) -> DataFrame:
    """(group, cluster_no, size, mean_distance, typical): each cluster's size and its members nearest to the centroid, ties to the smaller id."""
    salt = F.pmod(F.xxhash64(id_), F.lit(16))
    one = F.row_number().over(Window.partitionBy(group, "cluster_no", salt).orderBy("distance", id_))
    near = assigned.withColumn("r", one).filter(F.col("r") <= members)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(group, "cluster_no").orderBy("distance", id_))).filter(F.col("r") <= members)
    typical = near.groupBy(group, "cluster_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", id_))), lambda s: s[id_]).alias("typical"))
    size = assigned.groupBy(group, "cluster_no").agg(F.count(F.lit(1)).alias("size"), F.avg("distance").alias("mean_distance"))
    return size.join(typical, [group, "cluster_no"])
