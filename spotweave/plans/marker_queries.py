"""Marker genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions.keys import name_key, null_if_bad
from spotweave.functions.stats import competition_rank, min_max, rank_score, sigmoid
from spotweave.operators import clusters as c
from spotweave.operators import markers as k
from spotweave.operators.latest import latest_rows
from spotweave.operators.matrix import normalised
from spotweave.plans.base import CNT, LAB, NORM, RUN, counts, labels, tail_sql
from spotweave.session import table

CELL, GENE = "cell_id", "gene"
GROUP = [*RUN, "cluster"]


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def fast_markers(s, d):
    t = k.fast_markers(normalised(counts(s, d), RUN, CELL), labels(s, d), RUN, CELL, GENE, "x")
    return t.select(*GROUP, "rank", GENE, *r6("log2fc", "mean_in", "mean_out", "pct_in", "pct_out", "score"), "n_cells_in")


def marker_contrast(s, d):
    t = k.contrasts(counts(s, d), labels(s, d), RUN, CELL, GENE, "n")
    return t.select(*GROUP, GENE, *r6("mean_in", "mean_out", "contrast"))


def annotate_top3(s, d):
    t = k.fast_markers(normalised(counts(s, d), RUN, CELL), labels(s, d), RUN, CELL, GENE, "x")
    return k.name_clusters(t, GROUP, GENE, F.round("score", 9))


def wilcoxon_scores(s, d):
    t = k.rank_sum_scores(normalised(counts(s, d), RUN, CELL), labels(s, d), RUN, CELL, GENE, "x")
    return t.select(*GROUP, GENE, *r6("score", "logfoldchange"))


def wilcoxon_bh_significant(s, d):
    t = k.rank_sum_markers(normalised(counts(s, d), RUN, CELL), labels(s, d), RUN, CELL, GENE, "x")
    marks = k.significant(t).select(*GROUP, GENE, F.lit(True).alias("is_significant"))
    return t.join(marks, [*GROUP, GENE], "left").na.fill(False, ["is_significant"]).select(*GROUP, GENE, *r6("score", "logfoldchange", "pval", "pval_adj"), "is_significant")


def top20_markers(s, d):
    t = k.rank_sum_scores(normalised(counts(s, d), RUN, CELL), labels(s, d), RUN, CELL, GENE, "x").filter("logfoldchange > 0.5")
    return k.best_per_group(t, GROUP, F.round("score", 6), GENE, 20).select(*GROUP, "rank", GENE, *r6("score"))


def exported(s, d):
    m = table(s, d, "cluster_markers_all_cells_final").withColumn(GENE, name_key("names")).filter("gene is not null and gene <> '(CLUSTER TOO SMALL)'")
    m = latest_rows(m, [*GROUP, GENE], "exported_at", ["logfoldchanges", "pvals", "pvals_adj"])
    return m.select(*GROUP, GENE, *[null_if_bad(c).alias(c) for c in ("logfoldchanges", "pvals", "pvals_adj")])


def bh_readjusted(s, d):
    t = k.adjust_bh(exported(s, d).filter("pvals is not null"), GROUP, "pvals", "adjusted", GENE)
    return t.select(*GROUP, GENE, F.round("adjusted", 9).alias("adjusted"))


def de_strength(s, d):
    t = k.differential_strength(exported(s, d).filter("logfoldchanges is not null and pvals_adj is not null"), GROUP, "logfoldchanges", "pvals_adj", GENE)
    return t.select(*GROUP, *r6("median_log2fc", "mean_neglog10_fdr"), "n_top", "n_sig_markers")


def de_scores(s, d):
    t = de_strength(s, d)
    v = F.col("median_log2fc")
    return t.select(*GROUP, F.round(min_max(v, RUN), 6).alias("scaled"), F.round(rank_score(v, RUN), 6).alias("rank_score"))


def method_mean_sd(s, d):
    t = de_strength(s, d).groupBy(*RUN).agg(F.avg("median_log2fc").alias("m"))
    no = table(s, d, "runs").groupBy(*RUN).agg(F.max("dataset_no").alias("dataset_no"))
    return t.join(no, RUN).groupBy("dataset_no").agg(F.round(F.avg("m"), 6).alias("mean_m"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("sd_m"))


def bfdr_select(s, d):
    p = exported(s, d).filter("pvals_adj is not null").select(*GROUP, GENE, (1 - F.col("pvals_adj")).alias("p"))
    return k.select_bfdr(p, GROUP, "p", GENE).select(*GROUP, GENE, "rank", F.round("bfdr", 9).alias("bfdr"))


def marker_yield(s, d):
    """Every labelled cluster of a run with the number of its significant raised markers, 0 where there are none."""
    groups = labels(s, d).select(*GROUP).distinct()
    return k.yields(groups, exported(s, d).filter("pvals_adj < 0.05 and logfoldchanges > 0"), GROUP)


#: Weights of the differential-expression metrics that are at hand.
WEIGHTS = {"median_log2fc": 0.4, "mean_neglog10_fdr": 0.3, "n_sig_markers": 0.1}


def composite_scores(s, d):
    """Weighted mean of a cluster's rank scores within its run, over the metrics at hand, and its place (ties share the best)."""
    t = de_strength(s, d)
    score = sum(F.lit(w) * rank_score(F.col(c), RUN) for c, w in WEIGHTS.items()) / sum(WEIGHTS.values())
    t = t.select(*GROUP, F.round(score, 9).alias("score"))
    return t.select(*GROUP, F.round("score", 6).alias("score"), competition_rank(F.col("score"), RUN).cast("long").alias("place"))


def detection_quality(s, d):
    """Precision and recall of the significant raised markers against the published lists, per run."""
    said = table(s, d, "top10_markers_per_cluster_4").select(*GROUP, name_key("gene").alias(GENE)).filter("gene is not null").distinct().withColumn("t", F.lit(True))
    t = exported(s, d).join(said, [*GROUP, GENE], "left")
    t = t.select(*RUN, (F.coalesce(F.col("pvals_adj") < 0.05, F.lit(False)) & F.coalesce(F.col("logfoldchanges") > 0, F.lit(False))).alias("c"), F.coalesce("t", F.lit(False)).alias("t"))
    return c.detection_quality(t, RUN, "c", "t").select(*RUN, "n_selected", "n_true", *r6("precision", "recall"))


def adjusted_error(s, d):
    """Root mean square difference between the exported adjusted p values and those adjusted anew, per run."""
    t = k.adjust_bh(exported(s, d).filter("pvals is not null"), GROUP, "pvals", "anew", GENE)
    return c.root_mean_square(t, RUN, "pvals_adj", "anew").select(*RUN, "n", *r6("rmse"))


def sigmoid_evidence(s, d):
    """Each gene's probability of being no marker by a logistic of its fold change."""
    return exported(s, d).filter("logfoldchanges is not null").select(*GROUP, GENE, F.round(sigmoid(-F.col("logfoldchanges")), 6).alias("p"))


QUERIES = {f.__name__: f for f in (fast_markers, marker_contrast, annotate_top3, wilcoxon_scores, wilcoxon_bh_significant, top20_markers, bh_readjusted, de_strength, de_scores, method_mean_sd, bfdr_select, marker_yield, composite_scores, detection_quality, adjusted_error, sigmoid_evidence)}

INOUT = """
, {lab}, c as (select distinct run_id, cell_id, cluster from cnt join lab using (run_id, cell_id)),
sz as (select run_id, cluster, count(*) as n_in from c group by all),
szt as (select *, (sum(n_in) over (partition by run_id))::bigint as n_all from sz),
i as (select run_id, cluster, gene, sum({v}) as s, count(*) as p from {src} join lab using (run_id, cell_id) group by all),
w as (select run_id, gene, sum(s) as sa, sum(p) as pa from i group by all),
t as (select szt.run_id, szt.cluster, w.gene, n_in, coalesce(s, 0)::double / n_in as mean_in, (sa - coalesce(s, 0))::double / nullif(n_all - n_in, 0) as mean_out,
        coalesce(p, 0)::double / n_in as pct_in, (pa - coalesce(p, 0))::double / nullif(n_all - n_in, 0) as pct_out
      from szt join w using (run_id) left join i on i.run_id = szt.run_id and i.cluster = szt.cluster and i.gene = w.gene)
"""
FAST = NORM + INOUT.format(lab=LAB, v="x", src="nrm") + """
, u as (select *, (mean_in - mean_out) / ln(2) as fold from t where n_in >= 10 and mean_out is not null),
u2 as (select *, round(fold, 9) as log2fc, fold * pct_in * (pct_in - pct_out + 1) as score from u),
u3 as (select *, case when pct_in >= 0.1 and pct_in >= pct_out and log2fc > 0 then 2 when log2fc > 0 then 1 else 0 end as gate from u2),
u4 as (select *, max(gate) over (partition by run_id, cluster) as best from u3),
fm as (select *, row_number() over (partition by run_id, cluster order by round(score, 9) desc, gene) as rank from u4 where gate = best qualify rank <= 10)
"""
EXP = """
with x as (select run_id, cluster, upper(trim(names)) as gene, arg_max(struct_pack(a := logfoldchanges, b := pvals, c := pvals_adj),
             struct_pack(t := exported_at, a := coalesce(logfoldchanges, '-infinity'::double), b := coalesce(pvals, '-infinity'::double), c := coalesce(pvals_adj, '-infinity'::double))) as s
           from cluster_markers_all_cells_final where names is not null and upper(trim(names)) <> '(CLUSTER TOO SMALL)' group by all),
e as (select run_id, cluster, gene, case when not isnan(s.a) and not isinf(s.a) then s.a end as lfc, case when not isnan(s.b) and not isinf(s.b) then s.b end as p, case when not isnan(s.c) and not isinf(s.c) then s.c end as q from x)
"""
DE = EXP + """
, g as (select *, count(*) over (partition by run_id, cluster) as sig, row_number() over (partition by run_id, cluster order by lfc desc, gene) as rn from e where lfc > 0 and q < 0.05),
de as (select run_id, cluster, round(median(lfc), 6) as median_log2fc, round(avg(-log10(greatest(q, 1e-300))), 6) as mean_neglog10_fdr, count(*) as n_top, max(sig) as n_sig_markers from g where rn <= 20 group by all)
"""
RANKED = NORM + ", " + LAB + """
, c0 as (select distinct run_id, cell_id, cluster from cnt join lab using (run_id, cell_id)),
c as (select *, count(*) over (partition by run_id, cluster) as k from c0 qualify k >= 5),
v as (select run_id, cluster, gene, x, round(x, 9) as rx from nrm join c using (run_id, cell_id)),
vr as (select *, rank() over (partition by run_id, gene order by rx) + (count(*) over (partition by run_id, gene, rx) - 1) / 2.0::double as r from v),
t as (select run_id, cluster, gene, sum(r) as r, count(*) as p, sum(x) as s from vr group by all),
w as (select run_id, gene, sum(p) as pa, sum(s) as sa from t group by all),
sz0 as (select run_id, cluster, count(*)::double as n from c group by all), sz as (select *, sum(n) over (partition by run_id) as m from sz0),
f as (select sz.run_id, sz.cluster, w.gene, n, m, m - pa as z0, sa, coalesce(r, 0) as r, coalesce(p, 0) as p, coalesce(s, 0) as s
      from sz join w using (run_id) left join t on t.run_id = sz.run_id and t.cluster = sz.cluster and t.gene = w.gene where m > n),
fz as (select run_id, cluster, gene, (r + p * z0 + (n - p) * (z0 + 1) / 2 - n * (m + 1) / 2) / sqrt(n * (m - n) * (m + 1) / 12) as score,
       log2((exp(s / n) - 1 + 1e-9) / (exp((sa - s) / (m - n)) - 1 + 1e-9)) as lfc from f)
"""
WILCOXON = RANKED + "select run_id, cluster, gene, round(score, 6) as score, round(lfc, 6) as logfoldchange from fz"
SQL = {
    "fast_markers": FAST + """
select run_id, cluster, rank, gene, round(log2fc, 6) as log2fc, round(mean_in, 6) as mean_in, round(mean_out, 6) as mean_out, round(pct_in, 6) as pct_in, round(pct_out, 6) as pct_out, round(score, 6) as score, n_in as n_cells_in from fm
union all select distinct run_id, cluster, 1, '(cluster too small)', null, null, null, null, null, null, n_in from t where n_in < 10""",
    "marker_contrast": CNT + INOUT.format(lab=LAB, v="n", src="cnt") + "select run_id, cluster, gene, round(mean_in, 6) as mean_in, round(mean_out, 6) as mean_out, round(mean_in - mean_out, 6) as contrast from t",
    "annotate_top3": FAST + """
, z as (select run_id, cluster, rank, gene from fm union all select distinct run_id, cluster, 1, '(cluster too small)' from t where n_in < 10)
select run_id, cluster, string_agg(gene, '_' order by rank) as label from z where rank <= 3 group by all""",
    "wilcoxon_scores": WILCOXON,
    "wilcoxon_bh_significant": RANKED + f"""
, wp as (select *, {tail_sql("score")} as p from fz),
wr as (select *, row_number() over (partition by run_id, cluster order by p, gene) as rn, count(*) over (partition by run_id, cluster) as k from wp),
wq as (select *, least(min(p * k / rn) over (partition by run_id, cluster order by rn desc rows unbounded preceding), 1.0) as q from wr)
select run_id, cluster, gene, round(score, 6) as score, round(lfc, 6) as logfoldchange, round(p, 6) as pval, round(q, 6) as pval_adj, q < 0.05 and lfc > 0.5 as is_significant from wq""",
    "top20_markers": "select run_id, cluster, row_number() over (partition by run_id, cluster order by score desc, gene) as rank, gene, score from (" + WILCOXON + ") where logfoldchange > 0.5 qualify rank <= 20",
    "bh_readjusted": EXP + """
, r as (select *, row_number() over (partition by run_id, cluster order by p, gene) as rn, count(*) over (partition by run_id, cluster) as m from e where p is not null)
select run_id, cluster, gene, round(least(min(p * m / rn) over (partition by run_id, cluster order by rn desc rows unbounded preceding), 1.0), 9) as adjusted from r""",
    "de_strength": DE + "select * from de",
    "de_scores": DE + """
, q as (select *, count(*) over (partition by run_id) as n, rank() over (partition by run_id order by median_log2fc desc) + (count(*) over (partition by run_id, median_log2fc) - 1) / 2.0::double as r,
         min(median_log2fc) over (partition by run_id) as lo, max(median_log2fc) over (partition by run_id) as hi from de)
select run_id, cluster, round((median_log2fc - lo) / nullif(hi - lo, 0), 6) as scaled, round(case when n = 1 then 1.0 else (n - r) / (n - 1) end, 6) as rank_score from q""",
    "method_mean_sd": DE + """
, a as (select run_id, avg(median_log2fc) as m from de group by 1), n as (select run_id, max(dataset_no) as dataset_no from runs group by 1)
select dataset_no, round(avg(m), 6) as mean_m, round(coalesce(stddev_samp(m), 0), 6) as sd_m from a join n using (run_id) group by 1""",
    "bfdr_select": EXP + """
, r as (select run_id, cluster, gene, 1 - q as p, row_number() over (partition by run_id, cluster order by 1 - q desc, gene) as rank from e where q is not null),
m as (select *, round(avg(1 - p) over (partition by run_id, cluster order by rank rows unbounded preceding), 12) as b from r),
l as (select *, max(case when b <= 0.05 then rank end) over (partition by run_id, cluster) as last from m)
select run_id, cluster, gene, rank, round(b, 9) as bfdr from l where rank <= last""",
    "marker_yield": EXP + ", " + LAB + """
, g as (select distinct run_id, cluster from lab), n as (select run_id, cluster, count(*) as n from e where q < 0.05 and lfc > 0 group by all)
select run_id, cluster, coalesce(n, 0) as n_markers from g left join n using (run_id, cluster)""",
    "composite_scores": DE + "".join(f""", r{i} as (select run_id, cluster, case when count(*) over (partition by run_id) = 1 then 1.0::double else (count(*) over (partition by run_id) - (rank() over (partition by run_id order by {c} desc) + (count(*) over (partition by run_id, {c}) - 1) / 2.0::double)) / (count(*) over (partition by run_id) - 1) end as s from de)""" for i, c in enumerate(WEIGHTS)) + """
, z as (select run_id, cluster, round((0.4::double * r0.s + 0.3::double * r1.s + 0.1::double * r2.s) / 0.8, 9) as score from r0 join r1 using (run_id, cluster) join r2 using (run_id, cluster))
select run_id, cluster, round(score, 6) as score, rank() over (partition by run_id order by score desc) as place from z""",
    "detection_quality": EXP + """
, s as (select distinct run_id, cluster, upper(trim(gene)) as gene, true as t from top10_markers_per_cluster_4 where gene is not null),
j as (select e.run_id, coalesce(q < 0.05, false) and coalesce(lfc > 0, false) as c, coalesce(t, false) as t from e left join s on s.run_id = e.run_id and s.cluster = e.cluster and s.gene = e.gene)
select run_id, sum(c::int)::bigint as n_selected, sum(t::int)::bigint as n_true, round(sum((c and t)::int) / nullif(sum(c::int), 0), 6) as precision, round(sum((c and t)::int) / nullif(sum(t::int), 0), 6) as recall from j group by 1""",
    "adjusted_error": EXP + """
, r as (select *, row_number() over (partition by run_id, cluster order by p, gene) as rn, count(*) over (partition by run_id, cluster) as m from e where p is not null),
a as (select run_id, q, least(min(p * m / rn) over (partition by run_id, cluster order by rn desc rows unbounded preceding), 1.0) as anew from r)
select run_id, count(*) as n, round(sqrt(avg((q - anew) * (q - anew))), 6) as rmse from a where q is not null group by 1""",
    "sigmoid_evidence": EXP + "select run_id, cluster, gene, round(1 / (1 + exp(lfc)), 6) as p from e where lfc is not null",
}
