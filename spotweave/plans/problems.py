"""Queries of the general large-scale data problems (numbers 1, 2 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions.keys import name_key, present
from spotweave.operators import drift
from spotweave.operators.latest import latest_rows
from spotweave.operators.nearby import close_pairs, points_in_regions
from spotweave.operators.skew import heavy_keys, ordered_gaps, split_aggregate
from spotweave.session import broadcast_if_small, checkpoint, table

HEAVY_SHARE = 0.02
CLOSE_UM = 0.75
MARKERS = "cluster_markers_all_cells_final"


# Problem 1 -----------------------------------------------------------------------------------------


def _feeds(spark: SparkSession, d: str):
    lines, files, names = (table(spark, d, t) for t in ("raw_lines", "raw_files", "field_names"))
    loaded = {"transcripts": (table(spark, d, "transcripts"), ["transcript_id"]), MARKERS: (table(spark, d, MARKERS), ["run_id", "cluster", "names"])}
    records = drift.parsed_records(lines, files)
    return lines, files, names, loaded, records


def _scripts(spark: SparkSession, d: str):
    lines, files, names, loaded, records = _feeds(spark, d)
    return drift.edit_scripts(drift.file_schemas(lines, files, names, loaded, records)), records


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field between neighbouring files of a feed."""
    return drift.schema_changes(_scripts(spark, d)[0]).select("file_id", "field_name", "change_kind").distinct()


def p1_change_report(spark: SparkSession, d: str) -> DataFrame:
    """The same changes with the names and types before and after."""
    return drift.schema_changes(_scripts(spark, d)[0])


TRANSCRIPT_FIELDS = {"transcript_id": "long", "x_location": "double", "y_location": "double", "z_location": "double", "feature_name": "string", "qv": "double", "cell_id": "string"}
MARKER_FIELDS = {"cluster": "string", "names": "string"} | dict.fromkeys(("scores", "logfoldchanges", "pvals", "pvals_adj", "pct_nz_group", "pct_nz_reference"), "double")
SHARES = ["pct_nz_group", "pct_nz_reference"]


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    scripts, records = _scripts(spark, d)
    return drift.consistent_table(records, scripts, "transcripts", TRANSCRIPT_FIELDS)


def _markers(spark: SparkSession, d: str) -> DataFrame:
    lines, files, names, loaded, records = _feeds(spark, d)
    scripts = checkpoint(drift.edit_scripts(drift.file_schemas(lines, files, names, loaded, records)))
    rows, key = loaded[MARKERS]
    mine = files.join(scripts.filter(F.col("table_name") == MARKERS).select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.min("run_id").alias("run_id"))
    keys = checkpoint(drift.record_keys(drift.field_values(records), mine, names, MARKERS, key))
    state = drift.loaded_values(rows, key, SHARES, checkpoint(keys.select("record").distinct()))
    return drift.consistent_table(records, scripts, MARKERS, MARKER_FIELDS, drift.share_units(records, scripts, keys, state, SHARES))


def p1_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """All delivered molecule records as one table, whatever their files call and write the fields."""
    return _transcripts(spark, d).drop("unreadable")


def p1_markers(spark: SparkSession, d: str) -> DataFrame:
    """All delivered marker records as one table."""
    return _markers(spark, d).drop("unreadable")


def p1_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered value that could not be read as its field's type."""
    both = _transcripts(spark, d).select("file_id", "line_no", "unreadable").unionByName(_markers(spark, d).select("file_id", "line_no", "unreadable"))
    return both.select("file_id", "line_no", F.explode("unreadable").alias("field_name", "value"))


# Problem 2 -----------------------------------------------------------------------------------------


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("transcript_id", "qv", "loaded_at", "feature_name", "cell_id")
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), name_key(c).alias("key_value")) for c in ("feature_name", "cell_id")]))
    return t.select("transcript_id", "qv", "loaded_at", pair.alias("k")).select("k.field_name", "k.key_value", "transcript_id", "qv", "loaded_at").filter("key_value is not null and key_value <> ''")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The genes and cell ids that hold at least 2 % of all rows."""
    total = table(spark, d, "transcripts").count()
    rows = _keyed(spark, d).select("field_name", "key_value", "transcript_id")
    return heavy_keys(rows, ["field_name", "key_value"], ["transcript_id"], total, HEAVY_SHARE).select("field_name", "key_value")


def p2_key_profile(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean quality and share of every gene and cell id, heavy ones marked."""
    total = table(spark, d, "transcripts").count()
    qv = F.when(present("qv"), F.col("qv"))
    rows = _keyed(spark, d).select("field_name", "key_value", "transcript_id", qv.alias("qv"))
    one = split_aggregate(rows, ["field_name", "key_value"], ["transcript_id"], [F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("qv"), 6).alias("mean_qv"), F.min("transcript_id").alias("first_id"), F.max("transcript_id").alias("last_id")])
    return one.withColumn("is_heavy", F.col("n_rows") >= F.lit(HEAVY_SHARE * total))


P2_KEY_PROFILE = """
with t as (
  select 'feature_name' as field_name, upper(trim(feature_name)) as key_value, transcript_id, qv from transcripts
  union all select 'cell_id', upper(trim(cell_id)), transcript_id, qv from transcripts)
select field_name, key_value, count(*) as n_rows, round(avg(case when not isnan(qv) then qv end), 6) as mean_qv,
       min(transcript_id) as first_id, max(transcript_id) as last_id,
       count(*) >= 0.02 * (select count(*) from transcripts) as is_heavy
from t where key_value is not null and key_value <> '' group by all
"""


def p2_load_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per gene: first and last load second and the longest pause between two loads."""
    t = table(spark, d, "transcripts").select(name_key("feature_name").alias("key_value"), F.unix_seconds(F.col("loaded_at").cast("timestamp")).alias("second")).filter("key_value <> ''")
    return ordered_gaps(t, "key_value", "second")


P2_LOAD_GAPS = """
with t as (select upper(trim(feature_name)) as key_value, epoch(date_trunc('second', loaded_at))::bigint as s from transcripts where trim(feature_name) <> '' and loaded_at is not null),
g as (select *, s - lag(s) over (partition by key_value order by s) as gap from t)
select key_value, count(*) as n_rows, min(s) as first_value, max(s) as last_value, coalesce(max(gap), 0) as max_gap from g group by 1
"""

P2_FOUND = """
with t as (
  select 'feature_name' as field_name, upper(trim(feature_name)) as key_value from transcripts
  union all select 'cell_id', upper(trim(cell_id)) from transcripts)
select field_name, key_value from t where key_value is not null and key_value <> ''
group by all having count(*) >= 0.02 * (select count(*) from transcripts)
"""


# Problem 5 -----------------------------------------------------------------------------------------


def owned_molecules(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of every molecule with both coordinates that lies in a listed cell of its run."""
    t = latest_rows(table(spark, d, "transcripts"), ["transcript_id"], "loaded_at", ["run_id", "x_location", "y_location", "cell_id"])
    t = t.filter(present("x_location") & present("y_location") & F.col("transcript_id").isNotNull())
    listed = broadcast_if_small(checkpoint(table(spark, d, "cells").select("run_id", "cell_id").distinct()))
    return t.join(listed, ["run_id", "cell_id"], "left_semi").select("run_id", "transcript_id", "x_location", "y_location", "cell_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of molecules of different cells that lie at most 0.75 micrometres apart."""
    pairs = close_pairs(owned_molecules(spark, d), "run_id", "transcript_id", "x_location", "y_location", "cell_id", CLOSE_UM)
    return pairs.select(F.col("a").alias("transcript_id_a"), F.col("b").alias("transcript_id_b"))


P5_OWNED = """
with l as (select transcript_id, arg_max(struct_pack(run_id := run_id, x := x_location, y := y_location, cell_id := cell_id),
             struct_pack(t := loaded_at, a := run_id, b := coalesce(x_location, '-infinity'::double), c := coalesce(y_location, '-infinity'::double), e := coalesce(cell_id, ''))) as s
           from transcripts group by 1),
m as (select transcript_id as id, s.run_id as run_id, s.x as x, s.y as y, s.cell_id as cell_id from l
      where s.x is not null and s.y is not null and not isnan(s.x) and not isnan(s.y)
        and exists (select 1 from cells c where c.run_id = s.run_id and c.cell_id = s.cell_id))
"""

P5_FOUND = P5_OWNED + """
, g as (select *, floor(x / 0.75)::bigint as gx, floor(y / 0.75)::bigint as gy from m)
select least(a.id, b.id) as transcript_id_a, greatest(a.id, b.id) as transcript_id_b
from (select g.*, gx + dx as kx, gy + dy as ky from g, (values (-1), (0), (1)) s(dx), (values (-1), (0), (1)) u(dy)) a
join g b on a.run_id = b.run_id and a.kx = b.gx and a.ky = b.gy
where a.id < b.id and a.cell_id <> b.cell_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.5625
"""


def p5_neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per run and pair of cells: how many molecules of the two lie close to each other."""
    pairs = close_pairs(owned_molecules(spark, d), "run_id", "transcript_id", "x_location", "y_location", "cell_id", CLOSE_UM)
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("owner_a").alias("cell_id")), F.struct(F.col("b").alias("id"), F.col("owner_b").alias("cell_id")))).alias("e")
    per = pairs.select("run_id", ends).groupBy("run_id", "e.cell_id", "e.id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("run_id", "cell_id").agg(F.count(F.lit(1)).alias("n_molecules"), F.sum("n").alias("n_close"))


P5_NEIGHBOUR_COUNTS = "with pairs as (" + P5_FOUND + "), " + P5_OWNED.strip()[len("with "):] + """
, e as (select transcript_id_a as id from pairs union all select transcript_id_b from pairs),
n as (select id, count(*) as n from e group by 1)
select run_id, cell_id, count(*) as n_molecules, sum(n)::bigint as n_close from n join m using (id) group by all
"""


def cell_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Each cell's bounding box in micrometres as a polygon; runs without a pixel size and boxes with nulls are left out."""
    size = table(spark, d, "runs").groupBy("run_id").agg(F.max("pixel_size_um").alias("um"))
    c = table(spark, d, "cells").select("run_id", "cell_id", "x_min_px", "y_min_px", "x_max_px", "y_max_px").distinct().join(size, "run_id")
    x0, y0, x1, y1 = (F.col(f"{k}_px") * F.col("um") for k in ("x_min", "y_min", "x_max", "y_max"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return c.na.drop().select("run_id", "cell_id", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("corners"))


def p5_molecules_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of its run whose bounding box holds the molecule (each molecule in its latest state)."""
    t = latest_rows(table(spark, d, "transcripts"), ["transcript_id"], "loaded_at", ["run_id", "x_location", "y_location"])
    hits = points_in_regions(t, "run_id", "transcript_id", "x_location", "y_location", cell_boxes(spark, d), "cell_id", "corners", side=4.0, depth=1)
    return hits.select("transcript_id", "cell_id").distinct()


P5_MOLECULES_IN_BOXES = """
with l as (select transcript_id, arg_max(struct_pack(run_id := run_id, x := x_location, y := y_location),
             struct_pack(t := loaded_at, a := run_id, b := coalesce(x_location, '-infinity'::double), c := coalesce(y_location, '-infinity'::double))) as s from transcripts group by 1),
m as (select transcript_id, s.run_id as run_id, s.x as x, s.y as y from l where s.x is not null and s.y is not null and not isnan(s.x) and not isnan(s.y)),
b as (select distinct run_id, cell_id, x_min_px * um as x0, x_max_px * um as x1, y_min_px * um as y0, y_max_px * um as y1
      from cells join (select run_id, max(pixel_size_um) as um from runs group by 1) using (run_id))
select distinct transcript_id, cell_id from m join b on m.run_id = b.run_id and x between x0 and x1 and y between y0 and y1
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_change_report, p1_transcripts, p1_markers, p1_unreadable, p2_found, p2_key_profile, p2_load_gaps, p5_found, p5_neighbour_counts, p5_molecules_in_boxes)}
SQL = {"p2_found": P2_FOUND, "p2_key_profile": P2_KEY_PROFILE, "p2_load_gaps": P2_LOAD_GAPS, "p5_found": P5_FOUND, "p5_neighbour_counts": P5_NEIGHBOUR_COUNTS, "p5_molecules_in_boxes": P5_MOLECULES_IN_BOXES}
