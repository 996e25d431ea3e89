"""Communities of a neighbour graph by distributed local moving on modularity."""

from __future__ import annotations

from hashlib import md5
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.stats import portable_hash
from spotweave.operators.bayes import symmetric_edges
from spotweave.session import checkpoint


def _moved(e: DataFrame, by: list[str], resolution: str, rounds: int) -> DataFrame:
    """(by, node, c): communities after local moving on weighted edges (by, resolution, src, dst, w), until no node wishes to move."""
    degree = e.groupBy(*by, resolution, F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    state = degree.join(degree.groupBy(*by).agg(F.sum("k").alias("m2")), by)
    state = checkpoint(state.withColumn("c", F.col("node")))
    for i in count():
        size = state.groupBy(*by, "c").agg(F.sum("k").alias("k_all"))
        near = e.filter("src <> dst").join(state.select(*by, F.col("node").alias("dst"), "c"), [*by, "dst"]).groupBy(*by, F.col("src").alias("node"), "c").agg(F.sum("w").alias("links"))
        own = state.select(*by, resolution, "node", "k", "m2", F.col("c").alias("now"))
        options = near.unionByName(own.select(*by, "node", F.col("now").alias("c"), F.lit(0.0).alias("links"))).groupBy(*by, "node", "c").agg(F.sum("links").alias("links"))
        t = options.join(own, [*by, "node"]).join(size, [*by, "c"])
        stays = F.col("c") == F.col("now")
        gain = F.round(F.col("links") - F.col(resolution) * F.col("k") * (F.col("k_all") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m2"), 9)
        best = F.min(F.struct((-gain).alias("g"), (~stays).alias("moves"), "c"))
        t = t.groupBy(*by, resolution, "node", "k", "m2", "now").agg(best.alias("b"), F.max(F.when(stays, gain)).alias("own"))
        t = t.select(*by, resolution, "node", "k", "m2", "now", F.col("b.c").alias("to"), F.col("b.moves").alias("wish"), F.struct(F.round((F.col("b.g") + F.col("own")) * 1e9).cast("long").alias("less"), "node").alias("claim"))
        if i < rounds:
            turn = portable_hash(F.lit(str(i)), F.col("node").cast("string")) % 2 == 0
        else:
            t = checkpoint(t)
            first = t.filter("wish").select(*by, "claim", F.explode(F.array("now", "to")).alias("c")).groupBy(*by, "c").agg(F.min("claim").alias("first"))
            for c in ("now", "to"):
                t = t.join(first.withColumnsRenamed({"c": c, "first": f"first_{c}"}), [*by, c], "left")
            turn = F.coalesce((F.col("claim") == F.col("first_now")) & (F.col("claim") == F.col("first_to")), F.lit(False))
        new = checkpoint(t.select(*by, resolution, "node", "k", "m2", F.when(turn, F.col("to")).otherwise(F.col("now")).alias("c"), "wish"))
        state = new.drop("wish")
        # Nobody wishes to move, whoever's turn it is: a dataset's end does not depend on the others'.
        if new.filter("wish").isEmpty():
            return state.select(*by, "node", "c")


def _settled(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, turn, resolution: float, rounds: int) -> np.ndarray:
    """What ``_moved`` finds, inside a task: the community of each of n nodes, that is one of their numbers. Edges are sorted by ``src``; ``turn(i)`` says whose turn it is in round i."""
    k = np.bincount(src, w, n)
    m2, c = k.sum(), np.arange(n)
    real = src != dst
    src, dst, w = src[real], dst[real], w[real]

    even = bool((w == 1).all())

    def begin(x: np.ndarray) -> np.ndarray:
        """Where each run of equal numbers begins."""
        return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))

    def wishes(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best communities of the nodes ``some`` says and what they gain by them in units of 1e-9; of the others their own and 0."""
        at, use = np.flatnonzero(some), np.flatnonzero(some[src])
        key = np.concatenate((src[use] * n + c[dst[use]], at * n + c[at]))
        if even:
            key.sort()
            first = begin(key)
            links = np.diff(first, append=len(key)).astype(float)
        else:
            order = np.argsort(key)
            key = key[order]
            first = begin(key)
            links = np.add.reduceat(np.concatenate((w[use], np.zeros(len(at))))[order], first)
        key = key[first]
        node = key // n
        to = key - node * n
        stays = to == c[node]
        if even:
            links -= stays
        gain = links - resolution * k[node] * (size[to] - np.where(stays, k[node], 0.0)) / m2
        gain = np.copysign(np.floor(np.abs(gain) * 1e9 + 0.5), gain)
        begins = begin(node)
        top = np.maximum.reduceat(gain, begins)
        best, more = c.copy(), np.zeros(n)
        found = np.minimum.reduceat(np.where(gain == np.repeat(top, np.diff(begins, append=len(node))), np.where(stays, -1, to), n), begins)
        best[at], more[at] = np.where(found < 0, c[at], found), top - gain[stays]
        return best, more

    for i in count():
        size = np.bincount(c, k, n)
        mine = turn(i) if i < rounds else np.ones(n, bool)
        new, more = wishes(mine) if mine.any() else (c, None)
        if (new == c).all() and (mine.all() or (wishes(~mine)[0] == c).all()):
            return c
        if i >= rounds:
            at = np.flatnonzero(new != c)
            at = at[np.lexsort((at, -more[at]))]
            claim, rank = np.full(n, len(at)), np.arange(len(at))
            np.minimum.at(claim, c[at], rank)
            np.minimum.at(claim, new[at], rank)
            still = at[(claim[c[at]] < rank) | (claim[new[at]] < rank)]
            new[still] = c[still]
        c = new


def _grouped(src: np.ndarray, dst: np.ndarray, names: list[str], resolutions: list[float], rounds: int) -> list[np.ndarray]:
    """Inside a task: for each resolution the community of each node of one dataset, by its smallest member's number. Edges are both ways, each once, sorted; nodes are numbered in their order."""
    tails, turns = [f"_{x}".encode() for x in names], []

    def turn(i: int) -> np.ndarray:
        while len(turns) <= i:
            head = str(len(turns)).encode()
            turns.append(np.frombuffer(b"".join([md5(head + x).digest() for x in tails]), np.uint8)[3::16] % 2 == 0)
        return turns[i]

    out = []
    for resolution in resolutions:
        # The nodes of a level by their numbers, and the place of each first node's among them.
        level, place, a, b, w = np.arange(len(names)), np.arange(len(names)), src, dst, np.ones(len(src))
        while True:
            c = _settled(a, b, w, len(level), lambda i: turn(i)[level], resolution, rounds)  # noqa: B023
            head = np.full(len(level), len(level))
            np.minimum.at(head, c, np.arange(len(level)))
            kept, to = np.unique(head[c], return_inverse=True)
            place, done, level = to[place], len(kept) == len(level), level[kept]
            if done:
                break
            key, at = np.unique(to[a] * len(kept) + to[b], return_inverse=True)
            a, b, w = key // len(kept), key % len(kept), np.bincount(at, w)
        out.append(level[place])
    return out


def communities(edges: DataFrame, by: list[str], resolution: float = 1.0, resolutions: list[float] | None = None, rounds: int = 200, whole: int = 1_000_000) -> DataFrame:
    """(by, node, community): labels that raise modularity, by synchronous local moving and contraction; a community is named by its smallest member.

    In each round a pseudo-random half of the nodes (by portable hash, so any partitioning gives the same) moves to the neighbouring community with the greatest gain
    k_i,c - resolution * k_i * K_c / 2m, ties to the smaller name; moving halves at a time keeps neighbours from swapping for ever. When nothing moves, communities become the nodes of
    a weighted graph and the same goes on there, level by level, until a level merges nothing. Nodes moving at once can keep a small dense graph in motion for ever: in a level that is not settled after
    ``rounds``, a node moves only if no other one that would leave or enter one of its two communities gains more by it (ties to the smaller name). Each round then raises modularity, so it ends. With
    ``resolutions`` the labels of all of them are found, and come with a column ``resolution``. A dataset of up to ``whole`` edges as given is solved in one task, to the same labels; larger ones go on together,
    a round being two aggregations of the edge list whose result is checkpointed.
    Partitions differ from other optimisers'; compare modularity or agreement.
    """
    sweep = [float(r) for r in resolutions or [resolution]]
    lists = checkpoint(edges.filter("src <> dst").groupBy(*by, "src").agg(F.collect_set("dst").alias("dst")))
    kinds = {f.name: f.dataType.simpleString() for f in lists.schema}
    sizes = lists.groupBy(*by).agg(F.sum(F.size("dst")).alias("n"))
    # Turns are hashes of names as Spark writes them; a task writes only these kinds alike.
    large = checkpoint(sizes.filter(F.col("n") > (whole if kinds["src"] in ("string", "tinyint", "smallint", "int", "bigint") else 0)).select(*by))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        one, other = pdf["src"].to_numpy().repeat([len(x) for x in pdf["dst"]]), np.concatenate(pdf["dst"].to_numpy())
        ids, at = np.unique(np.concatenate((one, other)), return_inverse=True)
        a, b = at[: len(one)], at[len(one) :]
        key = np.unique(np.concatenate((a * len(ids) + b, b * len(ids) + a)))
        found = _grouped(key // len(ids), key % len(ids), [str(x) for x in ids], sweep, rounds)
        return pd.concat([pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "resolution": r, "node": ids, "community": ids[c]}) for r, c in zip(sweep, found)])

    schema = f"{''.join(f'{c} {kinds[c]}, ' for c in by)}resolution double, node {kinds['src']}, community {kinds['src']}"
    if large.isEmpty():
        names = checkpoint(lists.groupBy(*by).applyInPandas(solve, schema))
    else:
        small = checkpoint(lists.join(large, by, "left_anti").groupBy(*by).applyInPandas(solve, schema))
        names = small.unionByName(_together(lists.join(large, by, "left_semi").select(*by, "src", F.explode("dst").alias("dst")), by, sweep, rounds))
    return names if resolutions else names.drop("resolution")


def _together(edges: DataFrame, by: list[str], resolutions: list[float], rounds: int) -> DataFrame:
    """(by, resolution, node, community) of all datasets and resolutions in the same rounds."""
    some = F.explode(F.array(*[F.lit(r) for r in resolutions])).alias("resolution")
    keys = [*by, "resolution"]
    e = checkpoint(symmetric_edges(edges, by).select(*by, some, "src", "dst").withColumn("w", F.lit(1.0)).withColumn("gamma", F.col("resolution")))
    names = None
    while True:
        moved = _moved(e, keys, "gamma", rounds)
        head = moved.groupBy(*keys, "c").agg(F.min("node").alias("community"), F.count(F.lit(1)).alias("n"))
        level = checkpoint(moved.join(head, [*keys, "c"]).select(*keys, "node", "community", "n"))
        names = level.select(*keys, "node", "community") if names is None else names.withColumnRenamed("community", "via").join(level.select(*keys, F.col("node").alias("via"), "community"), [*keys, "via"]).select(*keys, "node", "community")
        names = checkpoint(names)
        if level.filter("n > 1").isEmpty():
            return names
        a, b = (level.select(*keys, F.col("node").alias(k), F.col("community").alias(f"{k}_c")) for k in ("src", "dst"))
        e = checkpoint(e.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).groupBy(*keys, "gamma", F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("w").alias("w")))


def _mean_silhouettes(labels: DataFrame, points: DataFrame, by: list[str], id_: str, v: str, block: int) -> DataFrame:
    """(by, resolution, silhouette): the mean of ``silhouettes`` for each resolution of ``labels``; the distances of a dataset of up to ``block`` points are taken once for all, in one task."""
    from spotweave.operators.clusters import silhouettes

    p = points.select(*by, F.col(id_).alias("node"), F.col(v).cast("array<double>").alias("v")).filter("v is not null")
    large = checkpoint(p.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select(*by))
    some = labels.groupBy(*by, "node").agg(F.collect_list(F.struct("resolution", F.col("community").cast("string").alias("community"))).alias("found"))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_numpy()).astype(float)
        t = pd.DataFrame([(i, f["resolution"], f["community"]) for i, found in enumerate(pdf["found"]) for f in found], columns=["i", "r", "c"])
        d = np.stack([np.sqrt(((m - row) ** 2).sum(1)) for row in m])
        out = []
        for r, one in t.groupby("r"):
            i = one["i"].to_numpy()
            names, own = np.unique(one["c"].to_numpy(dtype=str), return_inverse=True)
            if len(names) < 2:
                out.append((r, None))
                continue
            within, at, size = (d if len(i) == len(d) else d[np.ix_(i, i)]), np.arange(len(i)), np.bincount(own)
            total = within @ (own[:, None] == np.arange(len(names))).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                a, mean = total[at, own] / (size[own] - 1), total / size
                mean[at, own] = np.inf
                b = mean.min(1)
                top = np.maximum(a, b)
                s = np.where(size[own] == 1, 0.0, np.where(top > 0, (b - a) / top, 0.0))
            s = s[~np.isnan(s)]
            out.append((r, s.mean() if len(s) else None))
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "resolution": [x for x, _ in out], "silhouette": pd.Series([x for _, x in out], dtype=float)})

    placed = p.join(some, [*by, "node"])
    schema = f"{''.join(f'{c} {kinds[c]}, ' for c in by)}resolution double, silhouette double"
    if large.isEmpty():
        return placed.groupBy(*by).applyInPandas(means, schema)
    small = placed.join(large, by, "left_anti").groupBy(*by).applyInPandas(means, schema)
    rest = p.join(large, by, "left_semi").join(labels, [*by, "node"])
    return small.unionByName(silhouettes(rest, [*by, "resolution"], "node", "community", "v").groupBy(*by, "resolution").agg(F.avg("silhouette").alias("silhouette")))


def choose_resolution(labels: DataFrame, points: DataFrame, by: list[str], id_: str, v: str, min_clusters: int = 3, block: int = 4096) -> DataFrame:
    """(by, resolution, n_communities, silhouette, chosen): how many communities each resolution gives, their mean silhouette, and the one to take.

    Resolutions with one community are out. Among those with at least ``min_clusters`` the highest silhouette wins, ties to the smaller resolution; if there
    are none, most communities win. ``labels`` is that of ``communities`` with several resolutions, ``points`` (by, id_, v) the space silhouettes are taken in.
    Datasets of more than ``block`` points take the blocks of ``silhouettes``.
    """
    n = labels.groupBy(*by, "resolution").agg(F.countDistinct("community").alias("n_communities"))
    s = _mean_silhouettes(labels, points, by, id_, v, block)
    t = n.join(s, [*by, "resolution"], "left")
    usable = F.col("n_communities") >= 2
    order = F.row_number().over(Window.partitionBy(*by).orderBy(usable.desc(), (F.col("n_communities") >= min_clusters).desc(), F.when(F.col("n_communities") >= min_clusters, F.round("silhouette", 9)).otherwise(F.col("n_communities").cast("double")).desc_nulls_last(), "resolution"))
    return t.withColumn("chosen", (order == 1) & usable)


def modularity(edges: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_communities, modularity) of labels (by, node, community)."""
    e = symmetric_edges(edges, by)
    l = labels.select(*by, "node", "community")
    a, b = l.withColumnsRenamed({"node": "src", "community": "a"}), l.withColumnsRenamed({"node": "dst", "community": "b"})
    t = e.join(a, [*by, "src"]).join(b, [*by, "dst"])
    m2 = t.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("m2"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("inside"))
    k = t.groupBy(*by, "a").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy(*by).agg(F.sum(F.col("k") * F.col("k")).alias("k2"), F.count(F.lit(1)).alias("n_communities"))
    return m2.join(k, by).select(*by, "n_communities", (F.col("inside") - F.col("k2") / (F.col("m2") * F.col("m2"))).alias("modularity"))
