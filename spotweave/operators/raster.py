"""Label rasters as sparse pixel tables (by, y, x, label); background pixels have no row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators.graph import connected_components, joined
from spotweave.operators.skew import exact_quantiles, number_rows
from spotweave.session import checkpoint

#: What a border pixel adds to the perimeter, by the sum of its border neighbours' weights (1 itself, 2 beside, 10 across).
BORDER_CODES = {(5, 7, 15, 17, 25, 27): 1.0, (21, 33): 2.0**0.5, (13, 23): (1 + 2.0**0.5) / 2}


def region_properties(pixels: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, label, area, y, x, y_min, x_min, y_max, x_max, extent, major, minor, eccentricity): maxima exclusive.

    Axes are those of the ellipse with the region's second moments; a pixel is a unit square (1/12 is added to each variance).
    """
    p = pixels.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("area"), F.avg("y").alias("y"), F.avg("x").alias("x"), F.min("y").alias("y_min"), F.min("x").alias("x_min"), (F.max("y") + 1).alias("y_max"), (F.max("x") + 1).alias("x_max"),
        F.var_pop(F.col("y").cast("double")).alias("vy"), F.var_pop(F.col("x").cast("double")).alias("vx"), F.covar_pop(F.col("y").cast("double"), F.col("x").cast("double")).alias("c"),
    )
    a, b = F.col("vy") + 1 / 12, F.col("vx") + 1 / 12
    root = F.sqrt((a - b) * (a - b) + 4 * F.col("c") * F.col("c"))
    p = p.withColumn("l1", (a + b + root) / 2).withColumn("l2", F.greatest((a + b - root) / 2, F.lit(0.0)))
    extent = F.col("area") / ((F.col("y_max") - F.col("y_min")) * (F.col("x_max") - F.col("x_min")))
    return p.select(*by, label, "area", "y", "x", "y_min", "x_min", "y_max", "x_max", extent.alias("extent"), (4 * F.sqrt("l1")).alias("major"), (4 * F.sqrt("l2")).alias("minor"), F.sqrt(F.greatest(1 - F.col("l2") / F.col("l1"), F.lit(0.0))).alias("eccentricity"))


def _disc(radius: int) -> Column:
    around = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(dy * dy + dx * dx).alias("d2")) for dy, dx in around])


def boundary_pixels(pixels: DataFrame, by: list[str], label: str) -> DataFrame:
    """Pixels of a region with a 4-neighbour of another label or of none. One aggregate over the pixel and its neighbours; no self-join."""
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])).alias("s")
    t = pixels.select(*by, "y", "x", F.col(label).alias("label"), around)
    t = t.groupBy(*by, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).agg(
        F.max(F.when((F.col("s.dy") == 0) & (F.col("s.dx") == 0), F.col("label"))).alias("own"), F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return t.filter("own is not null").filter((F.col("n") < 5) | (F.col("lo") != F.col("hi"))).select(*by, "y", "x", F.col("own").alias(label))


def expand_labels(pixels: DataFrame, by: list[str], label: str, radius: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Each pixel within ``radius`` of a labelled one takes the nearest label; ties go to the smaller label.

    Only boundary pixels reach outwards: each offers its label to the disc round it, and a pixel takes the least (distance, label). Labelled pixels
    keep theirs. The cost is boundary times disc, and the minimum aggregates before the shuffle. No tile seams exist.
    """
    reach = boundary_pixels(pixels, by, label).select(*by, F.col("y").alias("y0"), F.col("x").alias("x0"), F.col(label).alias("l"), F.explode(_disc(radius)).alias("s"))
    offers = reach.select(*by, (F.col("y0") + F.col("s.dy")).alias("y"), (F.col("x0") + F.col("s.dx")).alias("x"), F.struct(F.col("s.d2").alias("d2"), F.col("l")).alias("o"))
    own = pixels.select(*by, "y", "x", F.struct(F.lit(-1).alias("d2"), F.col(label).alias("l")).alias("o"))
    out = offers.unionByName(own).groupBy(*by, "y", "x").agg(F.min("o").alias("o")).select(*by, "y", "x", F.col("o.l").alias(label))
    if height is not None:
        out = out.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    return out


def overlap_fraction(masks: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, n_foreground, overlap): share of the foreground pixels that more than one label claims; ``masks`` may hold a pixel several times."""
    c = masks.groupBy(*by, "y", "x").agg((F.min(label) != F.max(label)).alias("many"))
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("n_foreground"), F.avg(F.col("many").cast("double")).alias("overlap"))


def dilate_each(pixels: DataFrame, by: list[str], label: str, radius: int) -> DataFrame:
    """Every label's own dilation; pixels within reach of several labels come out once for each."""
    reach = boundary_pixels(pixels, by, label).select(*by, F.col("y").alias("y0"), F.col("x").alias("x0"), label, F.explode(_disc(radius)).alias("s"))
    out = reach.select(*by, (F.col("y0") + F.col("s.dy")).alias("y"), (F.col("x0") + F.col("s.dx")).alias("x"), label)
    return out.unionByName(pixels.select(*by, "y", "x", label)).distinct()


def footprint_jaccard(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_both, n_any, jaccard) of two foregrounds."""
    x = a.select(*by, "y", "x", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*by, "y", "x", F.lit(0).alias("a"), F.lit(1).alias("b")))
    x = x.groupBy(*by, "y", "x").agg(F.max("a").alias("a"), F.max("b").alias("b")).groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return x.withColumn("jaccard", F.col("n_both") / F.col("n_any"))


def relabel_dense(pixels: DataFrame, by: list[str], label: str) -> DataFrame:
    """Labels replaced by 1.. in ascending order within their dataset; the numbering sees distinct labels only."""
    names = number_rows(pixels.select(*by, label).distinct(), by, [label], "label_no")
    return pixels.join(names, [*by, label]).select(*by, "y", "x", "label_no")


def block_mean(image: DataFrame, by: list[str], value: str, factor: int, height: Column, width: Column) -> DataFrame:
    """(by, by_, bx, mean): mean of factor x factor blocks over the largest multiple of ``factor``; absent pixels are zeros."""
    rows = (height / factor).cast("long"), (width / factor).cast("long")
    t = image.withColumn("by_", F.floor(F.col("y") / factor)).withColumn("bx", F.floor(F.col("x") / factor)).filter((F.col("by_") < rows[0]) & (F.col("bx") < rows[1]))
    return t.groupBy(*by, "by_", "bx").agg((F.sum(value) / (factor * factor)).alias("mean"))


def percentile_rescale(image: DataFrame, by: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values mapped to [0, 1] between two percentiles of their dataset and clipped; all 0 where these are equal. Null values and NaN have no part in the percentiles."""
    q = exact_quantiles(image, by, value, {"__low": low, "__high": high})
    span = F.col("__high") - F.col("__low")
    return image.join(q, by, "left").withColumn("scaled", F.when(span > 0, F.least(F.greatest((F.col(value) - F.col("__low")) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).drop("__low", "__high")


def tile_statistics(image: DataFrame, by: list[str], value: str, tile: int) -> DataFrame:
    """(by, ty, tx, n, mean, sd) over a tile's present pixels: what skips empty or flat tiles."""
    t = image.groupBy(*by, F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def tile_grid(sizes: DataFrame, by: list[str], tile: int, overlap: int) -> DataFrame:
    """(by, y0, x0, y1, x1, core_y0, core_x0, core_y1, core_x1) of overlapping tiles over height x width; the last ones are ragged."""
    step, pad = tile - overlap, overlap // 2
    line = lambda size: F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step)))
    g = sizes.select(*by, "height", "width", line(F.col("height")).alias("y0")).select("*", line(F.col("width")).alias("x0"))
    end = lambda o, size: F.least(F.col(o) + tile, F.col(size))
    g = g.withColumn("y1", end("y0", "height")).withColumn("x1", end("x0", "width"))
    core = lambda o: F.when(F.col(o) == 0, 0).otherwise(F.col(o) + pad)
    stop = lambda o, size: F.when(F.col(o) == F.col(size), F.col(o)).otherwise(F.col(o) - pad)
    return g.select(*by, "y0", "x0", "y1", "x1", core("y0").alias("core_y0"), core("x0").alias("core_x0"), stop("y1", "height").alias("core_y1"), stop("x1", "width").alias("core_x1"))


def assign_points(points: DataFrame, pixels: DataFrame, by: list[str], id_: str, py: Column, px: Column, label: str) -> DataFrame:
    """(by, id_, label): the label under each point, its coordinates rounded half to even; points off every label are left out."""
    p = points.select(*by, id_, F.rint(py).cast("long").alias("y"), F.rint(px).cast("long").alias("x")).na.drop(subset=["y", "x"])
    return p.join(pixels.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), label), [*by, "y", "x"]).select(*by, id_, label)


def score_mappings(points: DataFrame, pixels: DataFrame, by: list[str], x: str, y: str, label: str, height: str, width: str) -> DataFrame:
    """(by, mapping, n_valid, n_assigned, n_cells, best): candidate maps of points onto the raster, the best marked.

    Candidates in order: as given, shifted to zero, both with axes swapped, and shifted and scaled to the raster with its swap where both scales exceed 1.2.
    The winner has most assigned points, then most points in bounds, then most labels; ties go to the first. ``pixels`` carries ``height`` and ``width``.
    """
    size = pixels.groupBy(*by).agg(F.max(height).alias("H"), F.max(width).alias("W"))
    box = points.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    p = points.select(*by, F.col(x).alias("x"), F.col(y).alias("y")).join(box, by).join(size, by)
    sx, sy = F.col("W") / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)), F.col("H") / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))
    xs, ys = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    stretch = (sx > 1.2) & (sy > 1.2)
    maps = [(F.col("x"), F.col("y"), None), (xs, ys, None), (F.col("y"), F.col("x"), None), (ys, xs, None), (xs * sx, ys * sy, stretch), (ys * sx, xs * sy, stretch)]
    cells = [F.struct(F.lit(i).alias("mapping"), F.rint(a).cast("long").alias("x"), F.rint(b).cast("long").alias("y")) for i, (a, b, _) in enumerate(maps)]
    options = F.array_compact(F.array(*[c if ok is None else F.when(ok, c) for c, (_, _, ok) in zip(cells, maps)]))
    q = p.select(*by, "H", "W", F.explode(options).alias("m")).select(*by, "m.mapping", "m.x", "m.y", "H", "W").filter("x >= 0 and y >= 0 and x < W and y < H")
    n = q.groupBy(*by, "mapping", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    hit = n.join(pixels.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(label).alias("__l")), [*by, "y", "x"], "left")
    t = hit.groupBy(*by, "mapping").agg(F.sum("n").alias("n_valid"), F.coalesce(F.sum(F.when(F.col("__l").isNotNull(), F.col("n"))), F.lit(0)).alias("n_assigned"), F.countDistinct("__l").alias("n_cells"))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_assigned"), F.desc("n_valid"), F.desc("n_cells"), "mapping"))
    return t.withColumn("best", r == 1)


def merge_tile_labels(masks: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, label, merged): labels of overlapping tiles that share more than half of the smaller one's pixels become one, named by its smallest label.

    Free of order: pairs are counted by an equi-join on pixels and closed transitively.
    """
    size = masks.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    claims = masks.groupBy(*by, "y", "x").agg(F.array_sort(F.collect_set(label)).alias("l")).filter(F.size("l") > 1)
    a, b = claims.select(*by, "y", "x", F.posexplode("l").alias("i", "a")), claims.select(*by, "y", "x", F.posexplode("l").alias("j", "b"))
    pair = a.join(b, [*by, "y", "x"]).filter("i < j").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("common"))
    sa, sb = (size.select(*by, F.col(label).alias(k), F.col("n").alias(f"n{k}")) for k in ("a", "b"))
    link = pair.join(sa, [*by, "a"]).join(sb, [*by, "b"]).filter(F.col("common") > 0.5 * F.least("na", "nb"))
    node = lambda c: F.struct(*by, F.col(c).alias("l"))
    comp = connected_components(link.select(node("a").alias("src"), node("b").alias("dst")))
    names = size.select(*by, label, node(label).alias("node")).join(comp, "node", "left")
    return names.select(*by, label, F.coalesce(F.col("component.l"), F.col(label)).alias("merged"))


def label_parts(pixels: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, label, y, x0, x1, part): the horizontal runs of each label's pixels and the 4-connected part each belongs to, named by the (y, x) it begins at.

    Runs, not pixels, are the nodes; runs of neighbouring rows are linked by an equi-join on (label, row) where they overlap.
    """
    w = Window.partitionBy(*by, label, "y").orderBy("x")
    p = pixels.select(*by, label, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    runs = p.withColumn("g", F.col("x") - F.row_number().over(w)).groupBy(*by, label, "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")
    runs = checkpoint(runs)
    above = runs.select(*by, label, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    node = lambda y, x: F.struct(*by, F.col(label).alias("l"), y.alias("y"), x.alias("x"))
    pair = runs.join(above, [*by, label, "y"]).filter("x0 <= a1 and a0 <= x1")
    comp = connected_components(pair.select(node(F.col("y"), F.col("x0")).alias("src"), node(F.col("y") - 1, F.col("a0")).alias("dst")))
    out = runs.withColumn("node", node(F.col("y"), F.col("x0"))).join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    return out.select(*by, label, "y", "x0", "x1", F.struct("c.y", "c.x").alias("part"))


def _hull_pixels(rows: np.ndarray) -> int:
    """Pixels whose centre lies in the convex hull of the edge midpoints of an object's pixels, given its rows (y, first x, last x)."""
    y, a, b = rows.T.astype(float)
    pts = np.unique(np.concatenate([np.stack(c, 1) for c in ((y, a - 0.5), (y, b + 0.5), (y - 0.5, a), (y + 0.5, a), (y - 0.5, b), (y + 0.5, b))]), axis=0)

    def chain(points) -> list:
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    at = np.arange(int(y.min()), int(y.max()) + 1)
    low, high = chain(pts), chain(pts[::-1])[::-1]
    ends = [np.interp(at, [p[0] for p in c], [p[1] for p in c]) for c in (low, high)]
    left, right = np.minimum(*ends), np.maximum(*ends)
    return int((np.floor(right + 1e-9) - np.ceil(left - 1e-9) + 1).sum())


def shape_statistics(pixels: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, label, area, perimeter, solidity): the length of a region's border and the share of its convex hull that it fills.

    Border pixels add 1, sqrt(2) or their mean after the pattern of border pixels round them. For the hull only each row's first and last pixel travel.
    """
    edge = boundary_pixels(pixels, by, label)
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit({0: 1, 1: 2, 2: 10}[abs(dy) + abs(dx)]).alias("w")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])).alias("s")
    code = edge.select(*by, label, "y", "x", around).groupBy(*by, label, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).agg(F.sum("s.w").alias("code"), F.max((F.col("s.w") == 1).cast("int")).alias("own")).filter("own = 1")
    length = F.lit(0.0)
    for codes, worth in BORDER_CODES.items():
        length = F.when(F.col("code").isin(*codes), F.lit(worth)).otherwise(length)
    border = code.groupBy(*by, label).agg(F.sum(length).alias("perimeter"))
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    row = pixels.groupBy(*by, label, F.col("y").cast("long").alias("y")).agg(F.min("x").cast("long").alias("a"), F.max("x").cast("long").alias("b"), F.count(F.lit(1)).alias("n"))
    rows = row.groupBy(*by, label).agg(F.sum("n").alias("area"), F.collect_list(F.array("y", "a", "b")).alias("rows"))

    def fill(batches):
        for b in batches:
            yield b[[*by, label, "area"]].assign(hull=[_hull_pixels(np.stack(r)) for r in b["rows"]])

    filled = rows.mapInPandas(fill, ", ".join([*[f"{c} {kinds[c]}" for c in [*by, label]], "area long", "hull long"]))
    return filled.join(border, [*by, label]).select(*by, label, "area", "perimeter", (F.col("area") / F.col("hull")).alias("solidity"))


def repair_geometry(pixels: DataFrame, by: list[str], label: str, min_area: int = 20, max_area: int = 20_000, fill: int = 32, min_solidity: float = 0.0) -> DataFrame:
    """Each label's largest 4-connected part, holes under ``fill`` pixels filled, labels outside the area bounds or under ``min_solidity`` dropped, renumbered 1.. by label.

    Parts and their areas are found in Spark, whatever a label's size; of equal parts the one that begins first stays. Filling only adds pixels, so a largest part above ``max_area``
    is out by the rule, and only parts within it are gathered, one object at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    parts = label_parts(pixels, by, label)
    area = parts.groupBy(*by, label, "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    best = area.groupBy(*by, label).agg(F.min(F.struct((-F.col("n")).alias("n"), "part")).alias("m")).filter(-F.col("m.n") <= max_area).select(*by, label, F.col("m.part").alias("part"))
    objects = parts.join(best, [*by, label, "part"]).groupBy(*by, label).agg(F.collect_list(F.array("y", "x0", "x1")).alias("runs"))

    def mended(runs) -> list[dict]:
        r = np.stack(runs)
        corner = np.array([r[:, 0].min() - 1, r[:, 1].min() - 1])
        mask = np.zeros((r[:, 0].max() - corner[0] + 2, r[:, 2].max() - corner[1] + 2), dtype=bool)  # with a rim of background
        for y, a, b in r:
            mask[y - corner[0], a - corner[1] : b - corner[1] + 1] = True
        at = np.arange(mask.size).reshape(mask.shape)
        right, down = ~mask[:, 1:] & ~mask[:, :-1], ~mask[1:] & ~mask[:-1]
        ground = joined(mask.size, np.concatenate((at[:, 1:][right], at[1:][down])), np.concatenate((at[:, :-1][right], at[:-1][down])))
        small = np.bincount(ground, minlength=mask.size) < fill
        small[0] = False  # what the rim is part of
        mask |= (~mask) & small[ground].reshape(mask.shape)
        out = np.argwhere(mask) + corner
        if not min_area <= len(out) <= max_area:
            return []
        if min_solidity > 0:
            rows = np.array([(y, out[out[:, 0] == y, 1].min(), out[out[:, 0] == y, 1].max()) for y in np.unique(out[:, 0])])
            if len(out) / _hull_pixels(rows) < min_solidity:
                return []
        return [{"y": int(y), "x": int(x)} for y, x in out]

    def mend(batches):
        for b in batches:
            yield b[[*by, label]].assign(spots=[mended(runs) for runs in b["runs"]])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"{label} {kinds[label]}", "spots array<struct<y long, x long>>"])
    # Labels are few bytes each but take a while: a stated number of partitions is not coalesced by size.
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = objects.repartition(tasks, *by, label).mapInPandas(mend, schema).select(*by, label, F.explode("spots").alias("s"))
    return relabel_dense(out.select(*by, "s.y", "s.x", label), by, label)


def overlap_record(masks: DataFrame, seeds: DataFrame, repaired: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, overlap_fraction_input, n_seeds, n_cells_out, n_dropped, median_area, iqr_area, median_solidity) of a dataset's overlapping masks and its repaired cells."""
    shape = checkpoint(shape_statistics(repaired, by, "label_no"))
    out = overlap_fraction(masks, by, label).select(*by, F.col("overlap").alias("overlap_fraction_input"))
    out = out.join(seeds.groupBy(*by).agg(F.countDistinct(label).alias("n_seeds")), by)
    out = out.join(shape.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells_out")), by, "left").withColumn("n_cells_out", F.coalesce("n_cells_out", F.lit(0).cast("long")))
    for column, marks in (("area", {"__q1": 0.25, "median_area": 0.5, "__q3": 0.75}), ("solidity", {"median_solidity": 0.5})):
        out = out.join(exact_quantiles(shape, by, column, marks), by, "left")
    return out.select(*by, "overlap_fraction_input", "n_seeds", "n_cells_out", (F.col("n_seeds") - F.col("n_cells_out")).alias("n_dropped"), "median_area", (F.col("__q3") - F.col("__q1")).alias("iqr_area"), "median_solidity")
