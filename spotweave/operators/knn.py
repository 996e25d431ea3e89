"""Exact nearest neighbours: in the plane by tiles of equal counts, in many dimensions by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.session import checkpoint

#: Quantiles that are taken of each axis; the tiles of a dataset are at most their square.
CUTS = 512


def _nearest(qx, qy, own: np.ndarray, x, y, k: int, most: np.ndarray | None = None):
    """(query, point, rank from 0, squared distance) of each query's k nearest points, ties to the earlier point; ``own`` is the point a query must not find, or -1."""
    out = []
    step = max(1, 4_000_000 // max(len(x), 1))
    for a in range(0, len(qx), step):
        d = (qx[a : a + step, None] - x) ** 2 + (qy[a : a + step, None] - y) ** 2
        mine = np.flatnonzero(own[a : a + step] >= 0)
        d[mine, own[a + mine]] = np.inf
        if most is not None:
            d[d > most[a : a + step, None]] = np.inf
        cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
        row, col = np.nonzero((d <= cut) & (d < np.inf))
        dist = d[row, col]
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        out.append((row[keep] + a, col[keep], rank[keep], dist[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _destinations(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The points of a tile that can be anyone's neighbours, by id: of those on one spot only the k + 1 with the smallest ids."""
    pdf = pdf.sort_values("id")
    return pdf[pdf.groupby(["x", "y"], sort=False).cumcount() <= k].reset_index(drop=True)


def _lists(n: int, query: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> tuple[list, list]:
    """Each query's neighbours and squared distances as lists."""
    ends = np.searchsorted(query, np.arange(1, n))
    return [c.tolist() for c in np.split(ids, ends)], [c.tolist() for c in np.split(dist, ends)]


def knn_plane(points: DataFrame, by: list[str], id_: str, x: str, y: str, k: int, include_self: bool = False, tile: int = 2048) -> DataFrame:
    """(by, src, dst, rank, dist): the ``k`` nearest points of the same dataset, ties to the smaller id.

    A dataset is cut into strips and these into tiles of about ``tile`` points each at quantiles of its coordinates, so that crowded and empty
    parts make the same work. A task finds each point's neighbours within its tile. Where the k-th of them is nearer than the edge of the tile they are certain. The other points ask the tiles
    that a circle through their k-th meets, by one more equi-join on tiles, and the answers are merged. Self is excluded by id, not by position, so points on one spot find each
    other; of any number of points on one spot only the k + 1 with the smallest ids are compared. Points with null, NaN or infinite coordinates or a null id have no edges; a dataset
    with fewer than k + 1 points gives all it has. Ids are unique within a dataset.
    """
    p = points.select(*[F.col(c) for c in by], F.col(id_).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = checkpoint(p.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("id").isNotNull()))
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    keys = "".join(f"{c} {kinds[c]}, " for c in by)
    place = [*by, "strip", "ty"]
    marks = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    some = lambda q, s: F.array_distinct(F.transform(F.sequence(F.lit(1), s - 1), lambda i: F.get(q, (i * CUTS / s).cast("int") - 1)))
    edges = lambda q, s: F.when(s > 1, some(q, s)).otherwise(F.array().cast("array<double>"))
    n = F.count(F.lit(1))
    pieces = F.least(F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.sqrt(n / tile))), F.lit(0))), F.lit(float(CUTS))).cast("int")
    strips = p.groupBy(*by).agg(pieces.alias("pieces"), F.percentile_approx("x", marks).alias("q"))
    strips = checkpoint(strips.select(*by, "pieces", edges(F.col("q"), F.col("pieces")).alias("ex")))
    below = lambda e, v: F.size(F.filter(e, lambda c: c <= v))
    t = p.join(strips, by).withColumn("strip", below("ex", F.col("x")))
    several = not strips.filter("pieces > 1").isEmpty()
    if several:
        rows = t.groupBy(*by, "strip", "pieces", "ex").agg(F.percentile_approx("y", marks).alias("q"))
        rows = checkpoint(rows.select(*by, "strip", "pieces", "ex", edges(F.col("q"), F.col("pieces")).alias("ey")))
        t = t.join(rows.select(*by, "strip", "ey"), [*by, "strip"]).withColumn("ty", below("ey", F.col("y")))
    else:
        t = t.withColumn("ey", F.array().cast("array<double>")).withColumn("ty", F.lit(0))
    low, high = (lambda e, i: F.coalesce(F.get(e, F.col(i) - 1), F.lit(float("-inf")))), (lambda e, i: F.coalesce(F.get(e, F.col(i)), F.lit(float("inf"))))
    t = t.select(*place, "id", "x", "y", low("ex", "strip").alias("x0"), high("ex", "strip").alias("x1"), low("ey", "ty").alias("y0"), high("ey", "ty").alias("y1"))
    found = f"{keys}strip int, ty int, src {kinds['id']}, x double, y double, dst array<{kinds['id']}>, d2 array<double>, reach double, sure boolean"

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        to = _destinations(pdf, k)
        at = pd.Index(to["id"]).get_indexer(pdf["id"])
        qx, qy = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        query, point, rank, dist = _nearest(qx, qy, np.full(len(pdf), -1) if include_self else at, to["x"].to_numpy(), to["y"].to_numpy(), k)
        reach = np.full(len(pdf), np.inf)
        reach[query[rank == k - 1]] = dist[rank == k - 1]
        edge = np.minimum.reduce([qx - pdf["x0"], pdf["x1"] - qx, qy - pdf["y0"], pdf["y1"] - qy])
        dst, d2 = _lists(len(pdf), query, to["id"].to_numpy()[point], dist)
        return pdf[[*place, "x", "y"]].assign(src=pdf["id"], dst=dst, d2=d2, reach=reach, sure=(edge == np.inf) | (np.sqrt(reach) < edge))[[*place, "src", "x", "y", "dst", "d2", "reach", "sure"]]

    one = checkpoint(t.groupBy(*place).applyInPandas(within, found))
    result = one.select(*by, "src", "dst", "d2")
    if several:
        ask = one.filter("not sure").withColumn("r", F.sqrt("reach") * (1 + 1e-9))
        span = lambda e, c: F.sequence(below(e, F.col(c) - F.col("r")), below(e, F.col(c) + F.col("r")))
        ask = ask.select(*by, F.col("strip").alias("s0"), F.col("ty").alias("t0"), "src", "x", "y", "reach", "r").join(strips.select(*by, "ex"), by)
        ask = ask.withColumn("strip", F.explode(span("ex", "x"))).drop("ex").join(rows.select(*by, "strip", "ey"), [*by, "strip"])
        ask = ask.withColumn("ty", F.explode(span("ey", "y"))).filter("strip <> s0 or ty <> t0").select(*place, "src", "x", "y", "reach")

        def beyond(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame(columns=[*by, "src", "dst", "d2"])
            to = _destinations(right, k)
            query, point, _, dist = _nearest(left["x"].to_numpy(), left["y"].to_numpy(), np.full(len(left), -1), to["x"].to_numpy(), to["y"].to_numpy(), k, left["reach"].to_numpy())
            dst, d2 = _lists(len(left), query, to["id"].to_numpy()[point], dist)
            return left[[*by, "src"]].assign(dst=dst, d2=d2)

        more = ask.groupBy(*place).cogroup(t.groupBy(*place)).applyInPandas(beyond, f"{keys}src {kinds['id']}, dst array<{kinds['id']}>, d2 array<double>")
        both = one.filter("not sure").select(*by, "src", "dst", "d2").unionByName(more)
        pairs = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d2", "dst")))), 1, k).alias("n")
        both = both.groupBy(*by, "src").agg(pairs).select(*by, "src", F.transform("n", lambda s: s["dst"]).alias("dst"), F.transform("n", lambda s: s["d2"]).alias("d2"))
        result = checkpoint(one.filter("sure").select(*by, "src", "dst", "d2").unionByName(both))
    return result.select(*by, "src", F.posexplode(F.arrays_zip("dst", "d2")).alias("rank", "n")).select(*by, "src", "n.dst", (F.col("rank") + 1).cast("long").alias("rank"), F.sqrt("n.d2").alias("dist"))


def knn_vectors(vectors: DataFrame, queries: DataFrame, id_: str, v: str, k: int, cosine: bool = False, block: int = 4096, by: list[str] | None = None) -> DataFrame:
    """(by, src, dst, rank, dist): the ``k`` nearest of ``vectors`` of the same dataset for each of ``queries``, exactly; self excluded by id, ties to the smaller id.

    Vectors and queries are packed into blocks of about ``block`` rows. A task compares one block of each and keeps its best k for every query; only these meet in the
    shuffle. The work grows with the product of both sizes, and nothing passes through the driver. ``cosine`` compares unit vectors by 1 - cosine. Null vectors and ids are left out;
    the vectors of a dataset have one length, and distances that agree to nine digits are ties.
    """
    by = list(by or [])
    rows = [df.select(*by, F.col(id_).alias("id"), F.col(v).cast("array<double>").alias("v")).filter("v is not null and id is not null").withColumn("__all", F.lit(0)) for df in (vectors, queries)]
    on = [*by, "__all"]
    kinds = {f.name: f.dataType.simpleString() for f in rows[0].schema}
    keys = "".join(f"{c} {kinds[c]}, " for c in on)
    size = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = checkpoint(size(rows[0], "nv").join(size(rows[1], "nq"), on))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.stack(pdf["v"].to_numpy()).astype(float)
        if cosine:
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return pd.DataFrame({**{c: pdf[c].iloc[:1].tolist() for c in [*on, "block"]}, "ids": [pdf["id"].tolist()], "m": [m.tobytes()]})

    def blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        cut = df.join(sizes, on).withColumn("block", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        packed = cut.groupBy(*on, "block").applyInPandas(pack, f"{keys}block int, ids array<{kinds['id']}>, m binary").withColumnRenamed("block", f"{own}_block")
        return packed.join(sizes.select(*on, other), on).withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(other)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*by, "src", "dst", "dist"])
        qid, vid = (np.asarray(d["ids"].iloc[0]) for d in (left, right))
        q, m = (np.frombuffer(d["m"].iloc[0]).reshape(len(i), -1) for d, i in ((left, qid), (right, vid)))
        d = np.maximum(1.0 - q @ m.T, 0.0) if cosine else np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ m.T + (m * m).sum(1)[None], 0.0))
        d = np.round(d, 9)
        d[qid[:, None] == vid[None]] = np.inf
        cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
        row, col = np.nonzero((d <= cut) & (d < np.inf))
        order = np.lexsort((col, d[row, col], row))
        row, col = row[order], col[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[keep], col[keep]
        return pd.DataFrame({**{c: left[c].iloc[0] for c in by}, "src": qid[row], "dst": vid[col], "dist": d[row, col]})

    a, b = blocks(rows[1], "nq", "nv"), blocks(rows[0], "nv", "nq")
    at = [*on, "nq_block", "nv_block"]
    near = a.groupBy(*at).cogroup(b.groupBy(*at)).applyInPandas(compare, f"{''.join(f'{c} {kinds[c]}, ' for c in by)}src {kinds['id']}, dst {kinds['id']}, dist double")
    w = Window.partitionBy(*by, "src").orderBy("dist", "dst")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(*by, "src", "dst", "rank", "dist")


def local_density(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, density): 1 / (mean distance + 1e-8), standardised over the dataset by the population deviation."""
    d = checkpoint(edges.groupBy(*by, "src").agg((1.0 / (F.avg("dist") + 1e-8)).alias("raw")))
    m = d.groupBy(*by).agg(F.avg("raw").alias("mean"), F.stddev_pop("raw").alias("sd"))
    return d.join(m, by).select(*by, "src", ((F.col("raw") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("density"))
