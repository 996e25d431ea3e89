"""Label rasters made from the molecules: a pixel of two micrometres belongs to the cell that owns most of its molecules."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import raster as r
from spotweave.plans.base import MOL, RUN, molecules
from spotweave.session import checkpoint, table

UM = 2.0
CELL = "cell_id"


def raster(s, d):
    m = molecules(s, d).select(*RUN, F.floor(F.col("y") / UM).cast("int").alias("y"), F.floor(F.col("x") / UM).cast("int").alias("x"), CELL)
    n = m.groupBy(*RUN, "y", "x", CELL).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*RUN, "y", "x").agg(F.min(F.struct((-F.col("n")).alias("n"), CELL)).alias("m")).select(*RUN, "y", "x", F.col("m.cell_id").alias("label"))


def image(s, d):
    m = molecules(s, d)
    return m.groupBy(*RUN, F.floor(F.col("y") / UM).cast("int").alias("y"), F.floor(F.col("x") / UM).cast("int").alias("x")).agg(F.count(F.lit(1)).alias("v"))


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def region_props(s, d):
    p = r.region_properties(raster(s, d), RUN, "label")
    return p.select(*RUN, "label", "area", *r6("y", "x"), "y_min", "x_min", "y_max", "x_max", *r6("extent", "major", "minor", "eccentricity"))


def boundary_pixels(s, d):
    return r.boundary_pixels(raster(s, d), RUN, "label")


def expand_labels_nearest(s, d):
    return r.expand_labels(raster(s, d), RUN, "label", 3)


def overlap_fraction(s, d):
    return r.overlap_fraction(r.dilate_each(raster(s, d), RUN, "label", 1), RUN, "label").select(*RUN, "n_foreground", *r6("overlap"))


def footprint_jaccard(s, d):
    p = raster(s, d)
    return r.footprint_jaccard(p, r.expand_labels(p, RUN, "label", 1), RUN).select(*RUN, "n_both", "n_any", *r6("jaccard"))


def relabel_dense(s, d):
    return r.relabel_dense(raster(s, d), RUN, "label")


def block_mean(s, d):
    i = image(s, d)
    i = i.join(i.groupBy(*RUN).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")), RUN)
    return r.block_mean(i, RUN, "v", 4, F.col("h"), F.col("w")).select(*RUN, "by_", "bx", *r6("mean"))


def percentile_rescale(s, d):
    return r.percentile_rescale(image(s, d), RUN, "v").select(*RUN, "y", "x", *r6("scaled"))


def tile_statistics(s, d):
    return r.tile_statistics(image(s, d), RUN, "v", 16).select(*RUN, "ty", "tx", "n", *r6("mean", "sd"))


def tile_grid(s, d):
    size = raster(s, d).groupBy(*RUN).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return r.tile_grid(size, RUN, 64, 16)


def assign_points(s, d):
    m = molecules(s, d)
    return r.assign_points(m, raster(s, d), RUN, "transcript_id", F.col("y") / UM - 0.5, F.col("x") / UM - 0.5, "label").groupBy(*RUN, "label").agg(F.count(F.lit(1)).alias("n"))


def assign_best_mapping(s, d):
    p = raster(s, d)
    p = p.join(p.groupBy(*RUN).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")), RUN)
    m = molecules(s, d).select(*RUN, (F.col("x") / UM).alias("x"), (F.col("y") / UM).alias("y"))
    return r.score_mappings(m, p, RUN, "x", "y", "label", "h", "w")


def roi_box(s, d):
    c = table(s, d, "cells").filter(F.col("x_centroid_px").between(1000, 1600) & F.col("y_centroid_px").between(700, 1300))
    return c.groupBy(*RUN).agg(F.countDistinct(CELL).alias("n_cells"))


def repaired_geometry(s, d):
    return r.repair_geometry(raster(s, d), RUN, "label", 3, 5000, 8)


def merged_tile_labels(s, d):
    """Each label's left and right halves, cut by tiles of 64 that overlap by 16, put together again."""
    p = raster(s, d)
    t = p.withColumn("t", F.explode(F.array_distinct(F.array(F.floor((F.col("x") - 16) / 48), F.floor(F.col("x") / 48)))))
    t = t.select(*RUN, "y", "x", F.concat_ws("#", "label", F.col("t").cast("string")).alias("label"))
    return r.merge_tile_labels(t, RUN, "label")


def label_part_sizes(s, d):
    """Per label: how many 4-connected parts it has and the area of the largest."""
    t = r.label_parts(raster(s, d), RUN, "label").groupBy(*RUN, "label", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    return t.groupBy(*RUN, "label").agg(F.count(F.lit(1)).alias("n_parts"), F.max("n").alias("largest"))


def region_perimeter(s, d):
    return r.shape_statistics(raster(s, d), RUN, "label").select(*RUN, "label", "area", *r6("perimeter"))


def region_solidity(s, d):
    return r.shape_statistics(raster(s, d), RUN, "label").select(*RUN, "label", *r6("solidity"))


def overlap_qc(s, d):
    p = raster(s, d)
    t = r.overlap_record(r.dilate_each(p, RUN, "label", 1), p, r.repair_geometry(p, RUN, "label", 3, 5000, 8), RUN, "label")
    return t.select(*RUN, *r6("overlap_fraction_input"), "n_seeds", "n_cells_out", "n_dropped", *r6("median_area", "iqr_area", "median_solidity"))


EXPANSIONS = (0, 1, 2, 3)


def expansion_sweep(s, d):
    """The grid of expansion radii: foreground, mean cell area, share of molecules that fall on a cell, and footprint overlap with the radius of 1."""
    p, m = checkpoint(raster(s, d)), checkpoint(molecules(s, d).select(*RUN, "transcript_id", "x", "y"))
    grids = {k: r.expand_labels(p, RUN, "label", k) if k else p for k in EXPANSIONS}
    total = m.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_molecules"))
    out = None
    for k, g in grids.items():
        size = g.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_foreground"), F.round(F.count(F.lit(1)) / F.countDistinct("label"), 6).alias("mean_area"))
        hit = r.assign_points(m, g, RUN, "transcript_id", F.col("y") / UM, F.col("x") / UM, "label").groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
        near = r.footprint_jaccard(g, grids[1], RUN).select(*RUN, *r6("jaccard"))
        one = size.join(total, RUN).join(hit, RUN, "left").join(near, RUN)
        one = one.select(*RUN, F.lit(k).alias("radius"), "n_foreground", "mean_area", F.round(F.coalesce("n", F.lit(0)) / F.col("n_molecules"), 6).alias("assigned"), "jaccard")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (region_props, boundary_pixels, expand_labels_nearest, overlap_fraction, footprint_jaccard, relabel_dense, block_mean, percentile_rescale, tile_statistics, tile_grid, assign_points, assign_best_mapping, roi_box, repaired_geometry, merged_tile_labels, label_part_sizes, region_perimeter, region_solidity, overlap_qc, expansion_sweep)}

RAS = MOL + """
, p0 as (select run_id, floor(y / 2)::int as y, floor(x / 2)::int as x, cell_id, count(*) as n from mol group by all),
px as (select run_id, y, x, cell_id as label from p0 qualify row_number() over (partition by run_id, y, x order by n desc, cell_id) = 1)
"""
IMG = MOL + ", im as (select run_id, floor(y / 2)::int as y, floor(x / 2)::int as x, count(*) as v from mol group by all)\n"


def disc_sql(radius: int) -> str:
    return "ds(dy, dx, d2) as (select a, b, a * a + b * b from range(-{0}, {0} + 1) s(a), range(-{0}, {0} + 1) t(b) where a * a + b * b <= {0} * {0})".format(radius)


def expand_sql(radius: int) -> str:
    return RAS + ", " + disc_sql(radius) + """
, ex as (select run_id, (y + dy)::int as y, (x + dx)::int as x, label, d2 from px, ds),
xp as (select run_id, y, x, label from ex qualify row_number() over (partition by run_id, y, x order by d2, label) = 1)
"""


MAPS = RAS + """
, b as (select run_id, min(x / 2) as x0, max(x / 2) as x1, min(y / 2) as y0, max(y / 2) as y1 from mol group by 1),
hw as (select run_id, max(y) + 1 as h, max(x) + 1 as w from px group by 1),
q as (select m.run_id, h, w, m.x / 2 as x, m.y / 2 as y, x0, y0, w / (x1 - x0) as sx, h / (y1 - y0) as sy from mol m join b using (run_id) join hw using (run_id)),
c as (select run_id, h, w, 0 as mapping, x as a, y as b from q union all select run_id, h, w, 1, x - x0, y - y0 from q union all select run_id, h, w, 2, y, x from q union all select run_id, h, w, 3, y - y0, x - x0 from q
  union all select run_id, h, w, 4, (x - x0) * sx, (y - y0) * sy from q where sx > 1.2 and sy > 1.2 union all select run_id, h, w, 5, (y - y0) * sx, (x - x0) * sy from q where sx > 1.2 and sy > 1.2),
i as (select run_id, h, w, mapping, round_even(a, 0)::bigint as x, round_even(b, 0)::bigint as y from c),
v as (select * from i where x >= 0 and y >= 0 and x < w and y < h),
t as (select v.run_id, mapping, count(*) as n_valid, count(label) as n_assigned, count(distinct label) as n_cells from v left join px on px.run_id = v.run_id and px.y = v.y and px.x = v.x group by all)
select *, row_number() over (partition by run_id order by n_assigned desc, n_valid desc, n_cells desc, mapping) = 1 as best from t
"""

SQL = {
    "region_props": RAS + """
, g as (select run_id, label, count(*) as area, avg(y) as y, avg(x) as x, min(y) as y_min, min(x) as x_min, max(y) + 1 as y_max, max(x) + 1 as x_max, var_pop(y) + 1 / 12 as a, var_pop(x) + 1 / 12 as b, covar_pop(y, x) as c from px group by all),
ll as (select *, (a + b + sqrt((a - b) ** 2 + 4 * c * c)) / 2 as l1, greatest((a + b - sqrt((a - b) ** 2 + 4 * c * c)) / 2, 0) as l2 from g)
select run_id, label, area, round(y, 6) as y, round(x, 6) as x, y_min, x_min, y_max, x_max, round(area / ((y_max - y_min) * (x_max - x_min)), 6) as extent, round(4 * sqrt(l1), 6) as major, round(4 * sqrt(l2), 6) as minor, round(sqrt(greatest(1 - l2 / l1, 0)), 6) as eccentricity from ll""",
    "boundary_pixels": RAS + """
, nb(dy, dx) as (values (-1, 0), (1, 0), (0, -1), (0, 1))
select distinct p.run_id, p.y, p.x, p.label from px p, nb left join px q on q.run_id = p.run_id and q.y = p.y + dy and q.x = p.x + dx where q.label is distinct from p.label""",
    "expand_labels_nearest": expand_sql(3) + "select * from xp",
    "overlap_fraction": RAS + ", " + disc_sql(1) + """
, ex as (select distinct run_id, (y + dy)::int as y, (x + dx)::int as x, label from px, ds), c as (select run_id, y, x, count(*) > 1 as many from ex group by all)
select run_id, count(*) as n_foreground, round(avg(many::int), 6) as overlap from c group by 1""",
    "footprint_jaccard": expand_sql(1) + "select run_id, sum((px.label is not null)::int)::bigint as n_both, count(*) as n_any, round(avg((px.label is not null)::int), 6) as jaccard from xp left join px using (run_id, y, x) group by 1",
    "relabel_dense": RAS + "select run_id, y, x, dense_rank() over (partition by run_id order by label) as label_no from px",
    "block_mean": IMG + """
, s as (select run_id, (max(y) + 1) // 4 as h, (max(x) + 1) // 4 as w from im group by 1)
select run_id, floor(y / 4)::bigint as by_, floor(x / 4)::bigint as bx, round(sum(v) / 16, 6) as mean from im join s using (run_id) where floor(y / 4) < h and floor(x / 4) < w group by all""",
    "percentile_rescale": IMG + """
, q as (select run_id, quantile_cont(v::double, 0.01) as a, quantile_cont(v::double, 0.99) as b from im group by 1)
select run_id, y, x, round(case when b > a then least(greatest((v - a) / (b - a), 0), 1) else 0 end, 6) as scaled from im join q using (run_id)""",
    "tile_statistics": IMG + "select run_id, floor(y / 16)::bigint as ty, floor(x / 16)::bigint as tx, count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd from im group by all",
    "tile_grid": RAS + """
, s as (select run_id, max(y) + 1 as h, max(x) + 1 as w from px group by 1),
g as (select run_id, h, w, y0, x0, least(y0 + 64, h) as y1, least(x0 + 64, w) as x1 from s, lateral (select unnest(range(0, h, 48)) as y0), lateral (select unnest(range(0, w, 48)) as x0))
select run_id, y0::int as y0, x0::int as x0, y1::int as y1, x1::int as x1, (case when y0 = 0 then 0 else y0 + 8 end)::int as core_y0, (case when x0 = 0 then 0 else x0 + 8 end)::int as core_x0, (case when y1 = h then y1 else y1 - 8 end)::int as core_y1, (case when x1 = w then x1 else x1 - 8 end)::int as core_x1 from g""",
    "assign_points": RAS + """
, a as (select run_id, round_even(y / 2 - 0.5, 0)::int as y, round_even(x / 2 - 0.5, 0)::int as x from mol)
select run_id, label, count(*) as n from a join px using (run_id, y, x) group by all""",
    "assign_best_mapping": MAPS,
    "roi_box": "select run_id, count(distinct cell_id) as n_cells from cells where x_centroid_px between 1000 and 1600 and y_centroid_px between 700 and 1300 group by 1",
    "label_part_sizes": "with recursive " + RAS.strip()[len("with "):] + """
, reach(run_id, label, y0, x0, y, x) as (select run_id, label, y, x, y, x from px
  union select a.run_id, a.label, a.y0, a.x0, b.y, b.x from reach a join px b on b.run_id = a.run_id and b.label = a.label and abs(b.y - a.y) + abs(b.x - a.x) = 1),
c as (select run_id, label, y, x, min({'y': y0, 'x': x0}) as part from reach group by all), n as (select run_id, label, part, count(*) as n from c group by all)
select run_id, label, count(*) as n_parts, max(n) as largest from n group by all""",
    "region_perimeter": RAS + """
, nb(dy, dx) as (values (-1, 0), (1, 0), (0, -1), (0, 1)), ar(dy, dx, w) as (select a, b, case abs(a) + abs(b) when 0 then 1 when 1 then 2 else 10 end from range(-1, 2) s(a), range(-1, 2) t(b)),
ed as (select distinct p.run_id, p.y, p.x, p.label from px p, nb left join px q on q.run_id = p.run_id and q.y = p.y + dy and q.x = p.x + dx where q.label is distinct from p.label),
co as (select e.run_id, e.label, e.y, e.x, sum(w) as code from ed e, ar join ed f on f.run_id = e.run_id and f.label = e.label and f.y = e.y + dy and f.x = e.x + dx group by all),
pe as (select run_id, label, sum(case when code in (5, 7, 15, 17, 25, 27) then 1.0::double when code in (21, 33) then sqrt(2) when code in (13, 23) then (1 + sqrt(2)) / 2 else 0 end) as perimeter from co group by all)
select run_id, label, count(*) as area, round(any_value(perimeter), 6) as perimeter from px join pe using (run_id, label) group by all""",
    "merged_tile_labels": "with recursive " + RAS.strip()[len("with "):] + """
, m as (select distinct run_id, y, x, label || '#' || t as label from (select run_id, y, x, label, unnest([floor((x - 16) / 48)::bigint, floor(x / 48)::bigint]) as t from px)),
n as (select run_id, label, count(*) as n from m group by all),
pr as (select a.run_id, a.label as a, b.label as b, count(*) as common from m a join m b on a.run_id = b.run_id and a.y = b.y and a.x = b.x and a.label <> b.label group by all),
li as (select pr.run_id, a, b from pr join n na on na.run_id = pr.run_id and na.label = a join n nb on nb.run_id = pr.run_id and nb.label = b where common > 0.5 * least(na.n, nb.n)),
reach(run_id, a, b) as (select run_id, label, label from n union select r.run_id, r.a, li.b from reach r join li on li.run_id = r.run_id and li.a = r.b)
select run_id, a as label, min(b) as merged from reach group by all""",
    "expansion_sweep": RAS + ", " + ", ".join(disc_sql(k).replace("ds(", f"ds{k}(") + f""", g{k} as (select run_id, y, x, label from (select run_id, (y + dy)::int as y, (x + dx)::int as x, label, d2 from px, ds{k}) qualify row_number() over (partition by run_id, y, x order by d2, label) = 1)""" for k in EXPANSIONS) + """
, t as (select run_id, count(*) as n from mol group by 1), q as (select run_id, round_even(y / 2, 0)::int as y, round_even(x / 2, 0)::int as x from mol)
""" + " union all ".join(f"""select * from (
select g.run_id, {k} as radius, count(*) as n_foreground, round(count(*) / count(distinct g.label), 6) as mean_area,
  round(coalesce((select count(*) from q join g{k} h on h.run_id = q.run_id and h.y = q.y and h.x = q.x where q.run_id = g.run_id), 0) / any_value(t.n), 6) as assigned,
  round(count(o.label) / (count(*) + any_value((select count(*) from g1 where g1.run_id = g.run_id)) - count(o.label)), 6) as jaccard
from g{k} g join t on t.run_id = g.run_id left join g1 o on o.run_id = g.run_id and o.y = g.y and o.x = g.x group by g.run_id)""" for k in EXPANSIONS),
}
