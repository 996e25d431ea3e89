"""Queries of the training-data problems (numbers 3, 4, 6, 7 and 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions.keys import name_key
from spotweave.llm.chunking import split_texts
from spotweave.llm.clusters import describe_clusters, linked_sets, ward_clusters
from spotweave.llm.leak import leaked_spans, without_leaks
from spotweave.llm.packing import pack
from spotweave.llm.tokens import count_tokens
from spotweave.llm.topn import top_n
from spotweave.operators.latest import latest_rows
from spotweave.session import table

MARKERS = "cluster_markers_all_cells_final"
CAPACITY, PIECE, OVERLAP = 4096, 1024, 64
STEP, LEAST = 0.30, 5
#: What stands where a leaked run was cut out.
REMOVED = " [removed] "


def current_markers(spark: SparkSession, d: str) -> DataFrame:
    """The latest export of each run, cluster and gene; placeholders and null names are no genes."""
    m = table(spark, d, MARKERS).select("run_id", "cluster", name_key("names").alias("gene"), "logfoldchanges", "exported_at")
    m = m.filter("gene is not null and gene <> '(CLUSTER TOO SMALL)'")
    return latest_rows(m, ["run_id", "cluster", "gene"], "exported_at", ["logfoldchanges"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten genes with the highest fold change of every run's cluster."""
    return top_n(current_markers(spark, d), ["run_id", "cluster"], F.col("logfoldchanges"), "gene", 10).select("run_id", "cluster", "gene")


P3_LATEST = """
with l as (select run_id, cluster, upper(trim(names)) as gene,
             arg_max(struct_pack(v := logfoldchanges), struct_pack(t := exported_at, v := coalesce(logfoldchanges, '-infinity'::double))).v as v
           from cluster_markers_all_cells_final where names is not null and upper(trim(names)) <> '(CLUSTER TOO SMALL)' group by all),
r as (select *, row_number() over (partition by run_id, cluster order by v desc, encode(gene)) as rank from l where v is not null and not isnan(v) and not isinf(v))
"""
P3_FOUND = P3_LATEST + "select run_id, cluster, gene from r where rank <= 10"


def p3_stale_lists(spark: SparkSession, d: str) -> DataFrame:
    """Per run and cluster: genes of the true top ten that the published list has, lacks, or has beyond it."""
    true = p3_found(spark, d).withColumn("t", F.lit(1))
    said = table(spark, d, "top10_markers_per_cluster_4").select("run_id", "cluster", name_key("gene").alias("gene")).filter("gene is not null").distinct().withColumn("s", F.lit(1))
    both = true.join(said, ["run_id", "cluster", "gene"], "full")
    n = lambda c: F.count(F.when(c, 1))
    t, s = F.col("t").isNotNull(), F.col("s").isNotNull()
    return both.groupBy("run_id", "cluster").agg(n(t & s).alias("n_right"), n(t & ~s).alias("n_missing"), n(~t & s).alias("n_stale"))


P3_STALE_LISTS = P3_LATEST + """
, t as (select run_id, cluster, gene, 1 as t from r where rank <= 10),
s as (select distinct run_id, cluster, upper(trim(gene)) as gene, 1 as s from top10_markers_per_cluster_4 where gene is not null)
select run_id, cluster, count(case when t is not null and s is not null then 1 end) as n_right,
       count(case when s is null then 1 end) as n_missing, count(case when t is null then 1 end) as n_stale
from t full join s using (run_id, cluster, gene) group by all
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of sets of at least five, linked by steps of at most 0.30 in their run's plane."""
    sets = linked_sets(table(spark, d, "umap_clusters_final"), "run_id", "cell_id", "umap1", "umap2", STEP, LEAST)
    return sets.select("run_id", "cell_id", F.col("head").alias("head_cell_id"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each run's Ward clusters with their size, mean distance to the centroid and three most typical cells."""
    assigned = ward_clusters(table(spark, d, "umap_clusters_final"), "run_id", "cell_id", "umap1", "umap2")
    return describe_clusters(assigned, "run_id", "cell_id")


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """The Ward cluster of every cell."""
    return ward_clusters(table(spark, d, "umap_clusters_final"), "run_id", "cell_id", "umap1", "umap2")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per run: cells that the Ward clusters hold, whether no cell is in two, and whether numbers run from 1 by falling size."""
    t = p4_members(spark, d).groupBy("run_id", "cluster_no").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("k"), F.min("distance").alias("low"))
    up = F.transform(F.array_sort(F.collect_list(F.struct("cluster_no", "n"))), lambda s: s["cluster_no"])
    return t.groupBy("run_id").agg(F.sum("n").alias("n_cells"), (F.sum("n") == F.sum("k")).alias("once"), (up == F.sequence(F.lit(1), F.count(F.lit(1)).cast("int"))).alias("numbered"), (F.min("low") >= 0).alias("measured"))


P4_TOTALS = "select run_id, count(distinct cell_id) as n_cells, true as once, true as numbered, true as measured from umap_clusters_final where isfinite(umap1) and isfinite(umap2) and cell_id is not null and run_id is not null group by 1"


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text (or of every piece of a text that exceeds one)."""
    return pack(count_tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Each container's pieces and unused space."""
    one = p6_containers(spark, d).groupBy("container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return one.withColumn("unused", F.lit(CAPACITY) - F.col("n_tokens"))


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per text: whether its pieces are all of its tokens, whether it is cut only if it exceeds a container, and whether its containers hold no more than they can."""
    tokens = count_tokens(table(spark, d, "documents"), "doc_id", "text")
    placed = pack(tokens, "doc_id", "n_tokens", CAPACITY)
    full = placed.groupBy("container_id").agg((F.sum("n_tokens") <= CAPACITY).alias("fits"))
    own = placed.join(full, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.min("fits").alias("fits"))
    least = F.greatest(F.ceil(F.col("n_tokens") / CAPACITY), F.lit(1))
    return tokens.join(own, "doc_id", "left").select("doc_id", F.coalesce(F.col("n") == F.col("n_tokens"), F.lit(False)).alias("whole"), F.coalesce(F.col("k") == least, F.lit(False)).alias("uncut"), F.coalesce("fits", F.lit(False)).alias("fits"))


P6_AUDIT = "select doc_id, true as whole, true as uncut, true as fits from documents where text is not null"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents one of whose parts holds at least 12 consecutive words of an item, or a whole shorter item."""
    # A document's spans come from one row, so its duplicates never leave their task before this.
    return _spans(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked run of words."""
    return _spans(spark, d)


def p7_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each part that holds leaks: remove the runs, or the part if they cover half of its words."""
    spans = _spans(spark, d).filter("part_words > 0")
    word = F.explode(F.expr("sequence(first_word, first_word + n_words - 1)"))
    one = spans.select("doc_id", "part_no", "part_words", "item_id", word.alias("w")).groupBy("doc_id", "part_no", "part_words").agg(F.countDistinct("w").alias("leaked_words"), F.countDistinct("item_id").alias("n_items"))
    return one.withColumn("decision", F.when(F.col("leaked_words") >= 0.5 * F.col("part_words"), "drop part").otherwise("cut runs"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every part of every message as it is read, leaked runs cut out, parts that are half leaked emptied."""
    return without_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text", mark=REMOVED)


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per document: whether its cleaned parts hold no leaked run any more."""
    items = table(spark, d, "eval_items")
    left = leaked_spans(p7_cleaned(spark, d), "doc_id", "text", items, "item_id", "item_text", part_no="part_no").select("doc_id").distinct().withColumn("clean", F.lit(False))
    return table(spark, d, "documents").filter("text is not null").select("doc_id").join(left, "doc_id", "left").na.fill(True, ["clean"])


P7_AUDIT = "select doc_id, true as clean from documents where text is not null"


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text longer than 1,024 tokens."""
    return split_texts(table(spark, d, "documents"), "doc_id", "text", PIECE, OVERLAP)


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces (texts within the limit as they are): its length and digest."""
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    new = F.expr("substring(text, overlap_chars + 1)")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("t")))), lambda s: s["t"]), "")
    split = p8_pieces(spark, d).groupBy("doc_id").agg(joined.alias("text"), (F.max("n_tokens") <= PIECE).alias("within"))
    short = docs.join(split.select("doc_id"), "doc_id", "left_anti").withColumn("within", F.lit(True))
    return split.unionByName(short).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "within")


P8_ROUND_TRIP = "select doc_id, length(text) as n_chars, md5(text) as digest, true as within from documents where text is not null"

QUERIES = {f.__name__: f for f in (p3_found, p3_stale_lists, p4_found, p4_clusters, p4_members, p4_totals, p6_containers, p6_fill, p6_audit, p7_found, p7_spans, p7_decisions, p7_cleaned, p7_audit, p8_pieces, p8_round_trip)}
P4_FOUND = """
with recursive p0 as (select run_id, cell_id, max(struct_pack(x := umap1::double, y := umap2::double)) as p from umap_clusters_final
             where umap1 is not null and umap2 is not null and not isnan(umap1) and not isnan(umap2) group by all),
pts as (select run_id, cell_id, p.x as x, p.y as y from p0),
near as (select a.run_id, a.cell_id as a, b.cell_id as b from pts a join pts b on a.run_id = b.run_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.30 * 0.30::double),
reach(run_id, a, b) as (select run_id, cell_id, cell_id from pts union select r.run_id, r.a, n.b from reach r join near n on n.run_id = r.run_id and n.a = r.b)
select run_id, b as cell_id, min(a) as head_cell_id from reach group by all having count(*) >= 5
"""

SQL = {"p3_found": P3_FOUND, "p4_found": P4_FOUND, "p3_stale_lists": P3_STALE_LISTS, "p4_totals": P4_TOTALS, "p6_audit": P6_AUDIT, "p7_audit": P7_AUDIT, "p8_round_trip": P8_ROUND_TRIP}
