"""Points near other points, and points inside regions, through cell coverage and equi-joins.

A region (a disc round a point, a convex polygon) is covered by square cells of a hierarchy.
A cell wholly inside the region is *interior*: every point in it matches at once. A cell cut by
the outline is a *boundary* cell: only its points get the exact test. Cells are split where it pays:
polygons down to ``depth`` levels, discs only where a cell is crowded. All joins are equi-joins on
(partition, level, cell), which Spark shuffles and, with AQE, splits where they are skewed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.session import broadcast_if_small, checkpoint


def _cells(x, y, side: float, radius: float, forward: bool = False):
    """Cells of side ``side`` within ``radius`` of (x, y): array of (cx, cy, inside); ``forward``: none behind the point's own."""
    reach = math.ceil(radius / side)
    cx, cy = F.floor(x / side), F.floor(y / side)
    found = []
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            if forward and (dx, dy) < (0, 0):
                continue
            low_x, low_y = (cx + dx) * side, (cy + dy) * side
            near_x = F.greatest(low_x - x, x - (low_x + side), F.lit(0.0))
            near_y = F.greatest(low_y - y, y - (low_y + side), F.lit(0.0))
            far_x = F.greatest(F.abs(low_x - x), F.abs(low_x + side - x))
            far_y = F.greatest(F.abs(low_y - y), F.abs(low_y + side - y))
            cell = F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy"), (far_x * far_x + far_y * far_y <= radius * radius).alias("inside"))
            found.append(F.when(near_x * near_x + near_y * near_y <= radius * radius, cell))
    return F.array_compact(F.array(*found))


def close_pairs(points: DataFrame, partition: str, id_: str, x: str, y: str, owner: str, radius: float, crowded: int = 64) -> DataFrame:
    """Pairs (partition, a, b, owner_a, owner_b), a < b by ``id_``, of one partition with different owners, at most ``radius`` apart.

    Each disc is covered by cells of twice its radius. Cells holding more than ``crowded`` points are
    split into cells of radius/4 on both sides of the join; there most of the disc is interior, and its
    points match without a distance test. In a split cell the points of its most frequent owner are compared with those of other owners only, so what is compared and
    dropped is never more than what comes out. Each unordered pair of cells is visited once: cover cells
    behind the point's own cell are left to the other point. Rows with a null id, owner or partition, or
    a coordinate that is null, NaN or infinite have no pair. Repeated ids would repeat pairs: reduce first.
    """
    big, small = 2.0 * radius, radius / 4.0
    p = points.select(F.col(partition).alias("part"), F.col(id_).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(owner).alias("own"))
    p = p.filter(F.col("part").isNotNull() & F.col("id").isNotNull() & F.col("own").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    p = checkpoint(p)
    on = ["part", "gx", "gy"]
    count = F.count(F.lit(1)).over(Window.partitionBy(*on))
    right = p.withColumn("gx", F.floor(F.col("x") / big)).withColumn("gy", F.floor(F.col("y") / big)).select(*on, "id", "x", "y", "own").withColumn("n", count)

    cover = F.transform(_cells(F.col("x"), F.col("y"), big, radius, forward=True), lambda c: F.struct(c["cx"], c["cy"]))
    left = p.select("part", "id", "x", "y", "own", F.explode(cover).alias("c")).select("part", "c.cx", "c.cy", "id", "x", "y", "own").toDF(*on, "id", "x", "y", "own")

    def matched(l: DataFrame, r: DataFrame, on: list[str], inside: Column) -> DataFrame:
        r = r.select(*on, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("own").alias("own2"))
        far = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
        own_cell = (F.floor(F.col("x") / big) == F.col("gx")) & (F.floor(F.col("y") / big) == F.col("gy"))
        both = l.join(r, on).filter((F.col("own") != F.col("own2")) & (~own_cell | (F.col("id") < F.col("id2"))) & (inside | (far <= radius * radius)))
        turned = F.col("id") > F.col("id2")
        own = [F.when(turned, F.col(x)).otherwise(F.col(y)) for x, y in (("own2", "own"), ("own", "own2"))]
        return both.select(F.col("part").alias(partition), F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), own[0].alias("owner_a"), own[1].alias("owner_b"))

    # No cell of twice the radius lies within a disc, so all of these are boundary cells.
    calm = matched(left, right.filter(F.col("n") <= crowded), on, F.lit(False))
    crowd = right.filter(F.col("n") > crowded)
    hot = checkpoint(crowd.select(*on).distinct())
    if hot.isEmpty():
        return calm
    fine_cells = F.filter(_cells(F.col("x"), F.col("y"), small, radius), lambda c: (F.floor(c["cx"] * small / big) == F.col("gx")) & (F.floor(c["cy"] * small / big) == F.col("gy")))
    fine = left.join(broadcast_if_small(hot), on, "left_semi").select(*on, "id", "x", "y", "own", F.explode(fine_cells).alias("c")).select(*on, "id", "x", "y", "own", F.col("c.cx").alias("fx"), F.col("c.cy").alias("fy"), F.col("c.inside").alias("inside"))
    within = crowd.select(*on, "id", "x", "y", "own", F.floor(F.col("x") / small).alias("fx"), F.floor(F.col("y") / small).alias("fy"))
    cell = [*on, "fx", "fy"]
    most = within.groupBy(*cell, "own").agg(F.count(F.lit(1)).alias("n")).groupBy(*cell).agg(F.max(F.struct("n", "own")).alias("m")).select(*cell, F.col("m.own").alias("frequent"))
    # Side 1 of a cell holds its most frequent owner, side 0 the rest; points of that owner look at side 0 alone.
    within = within.join(most, cell).withColumn("side", (F.col("own") == F.col("frequent")).cast("int")).drop("frequent")
    fine = fine.join(most, cell).withColumn("side", F.explode(F.when(F.col("own") == F.col("frequent"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).drop("frequent")
    return calm.unionByName(matched(fine, within, [*cell, "side"], F.col("inside")))


def cover_polygons(regions: DataFrame, partition: str, id_: str, vertices: str, side: float, depth: int = 2) -> DataFrame:
    """Cells (level, cx, cy, inside) that cover each convex polygon.

    ``vertices`` is array<struct<x double, y double>> in anticlockwise order. Level 0 has cells of ``side``;
    a cell cut by the outline is split in four until ``depth``. A region with fewer than three vertices, or
    with null or infinite ones, has no cell. Each region is covered on its own, in Arrow batches.
    """
    kinds = {f.name: f.dataType.simpleString() for f in regions.schema}
    schema = f"part {kinds[partition]}, region {kinds[id_]}, level int, cx long, cy long, inside boolean, ax array<double>, ay array<double>"

    def sweep(batches):
        for batch in batches:
            out = []
            for part, region, corners in zip(batch["part"], batch["region"], batch["corners"]):
                xy = np.array([(c["x"], c["y"]) for c in corners], dtype=float) if corners is not None and len(corners) > 2 else np.zeros((0, 2))
                if len(xy) < 3 or not np.isfinite(xy).all():
                    continue
                step = np.roll(xy, -1, 0) - xy
                low, high = np.floor(xy.min(0) / side).astype(int), np.floor(xy.max(0) / side).astype(int)
                gx, gy = (g.ravel() for g in np.meshgrid(np.arange(low[0], high[0] + 1), np.arange(low[1], high[1] + 1)))
                for level in range(depth + 1):
                    s = side / 2**level
                    px, py = (np.stack([g, g + 1, g + 1, g]) * s for g in (gx, gy))
                    px, py = px[[0, 1, 2, 3]], np.stack([gy, gy, gy + 1, gy + 1]) * s
                    cross = step[:, 0][:, None, None] * (py - xy[:, 1][:, None, None]) - step[:, 1][:, None, None] * (px - xy[:, 0][:, None, None])
                    inside = (cross > 0).all((0, 1))
                    apart = (cross < 0).all(1).any(0) | (px.max(0) < xy[:, 0].min()) | (px.min(0) > xy[:, 0].max()) | (py.max(0) < xy[:, 1].min()) | (py.min(0) > xy[:, 1].max())
                    done = inside | (~apart if level == depth else np.zeros(len(gx), bool))
                    for cx, cy, i in zip(gx[done], gy[done], inside[done]):
                        out.append((part, region, level, int(cx), int(cy), bool(i), None if i else xy[:, 0].tolist(), None if i else xy[:, 1].tolist()))
                    cut = ~done & ~apart
                    gx, gy = (np.concatenate([2 * g[cut] + d for d in ds]) for g, ds in ((gx, (0, 1, 0, 1)), (gy, (0, 0, 1, 1))))
                    if not len(gx):
                        break
            yield pd.DataFrame(out, columns=["part", "region", "level", "cx", "cy", "inside", "ax", "ay"])

    narrow = regions.select(F.col(partition).alias("part"), F.col(id_).alias("region"), F.col(vertices).alias("corners"))
    # Regions are few bytes each but take a while: a stated number of partitions is not coalesced by size.
    tasks = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return narrow.repartition(tasks, "part", "region").mapInPandas(sweep, schema)


def points_in_regions(points: DataFrame, partition: str, id_: str, x: str, y: str, regions: DataFrame, region_id: str, vertices: str, side: float, depth: int = 2) -> DataFrame:
    """(partition, id_, region_id) for every point inside or on the outline of a region of its partition.

    Each point looks up its cell at every level; interior cells match by equality alone, boundary cells
    carry the outline and get the exact half-plane test. Points with null, NaN or infinite coordinates
    lie in no region; a point in several overlapping regions comes out once for each.
    """
    cover = cover_polygons(regions, partition, region_id, vertices, side, depth)
    p = points.select(F.col(partition).alias("part"), F.col(id_).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    levels = [F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / (side / 2**k)).alias("cx"), F.floor(F.col("y") / (side / 2**k)).alias("cy")) for k in range(depth + 1)]
    keyed = p.select("*", F.explode(F.array(*levels)).alias("c")).select("part", "id", "x", "y", "c.level", "c.cx", "c.cy")
    n = F.size("ax")
    nxt = lambda i: F.when(i + 1 == n, 0).otherwise(i + 1)
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    edge = lambda i: (at("ax", nxt(i)) - at("ax", i)) * (F.col("y") - at("ay", i)) - (at("ay", nxt(i)) - at("ay", i)) * (F.col("x") - at("ax", i)) >= 0
    exact = F.forall(F.sequence(F.lit(0), n - 1), edge)
    hit = keyed.join(cover, ["part", "level", "cx", "cy"]).filter(F.col("inside") | exact)
    return hit.select(F.col("part").alias(partition), F.col("id").alias(id_), F.col("region").alias(region_id))
