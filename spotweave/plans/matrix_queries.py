"""Counts, quality filters and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import matrix as m
from spotweave.plans.base import CNT, NORM, RUN, XY, centroids, counts
from spotweave.session import table

CELL, GENE = "cell_id", "gene"
def r6(name: str):
    return F.round(name, 6).alias(name)


def count_matrix_long(s, d):
    return counts(s, d)


def count_matrix_wide(s, d):
    """The lines of the dense cell-by-gene file over the whole panel, in the order of its codewords."""
    return m.dense_rows(counts(s, d), RUN, CELL, GENE, table(s, d, "gene_panel"), "codeword", "feature_name")


def matrix_market_triplets(s, d):
    return m.triplets(counts(s, d), CELL, GENE)


def qc_cell_metrics(s, d):
    return m.cell_metrics(counts(s, d), RUN, CELL)


def qc_gene_metrics(s, d):
    return m.gene_metrics(counts(s, d), RUN, GENE)


def qc_min_counts(s, d):
    return m.cell_metrics(m.min_counts(counts(s, d), RUN, CELL, 150), RUN, CELL)


def qc_relaxed_filter(s, d):
    return m.relaxed_filter(counts(s, d), RUN, CELL, GENE, 40, 8)


def top_gene_cap(s, d):
    return m.top_genes(counts(s, d), RUN, GENE, 5050)


def adaptive_quantile_qc(s, d):
    return m.quantile_filter(counts(s, d), RUN, CELL, GENE, "^JUX").select(*RUN, CELL, "n_counts", "n_genes", r6("percent"))


def pattern_fraction(s, d):
    return m.pattern_fraction(counts(s, d), RUN, CELL, GENE, "^(JUX|XAZ)").select(*RUN, CELL, "n_match", r6("fraction"))


def background_subtract(s, d):
    control = table(s, d, "gene_panel").filter("feature_class = 'control'").select(F.col("feature_name").alias(GENE), F.lit(True).alias("is_control")).distinct()
    c = counts(s, d).join(control, GENE, "left")
    return m.subtract_background(c, RUN, CELL, GENE, F.col("is_control")).select(*RUN, CELL, GENE, r6("n"))


def lognorm(s, d):
    return m.normalised(counts(s, d), RUN, CELL).select(*RUN, CELL, GENE, r6("x"))


def zscore_clip(s, d):
    return m.zscores(m.normalised(counts(s, d), RUN, CELL), RUN, CELL, GENE, "x").select(*RUN, CELL, GENE, r6("z"), r6("zero"))


def pearson_residuals(s, d):
    return m.pearson_residuals(counts(s, d), RUN, CELL, GENE).select(*RUN, CELL, GENE, r6("residual"))


def hvg_dispersion(s, d):
    return m.variable_genes(counts(s, d), RUN, CELL, GENE, 2000).select(*RUN, GENE, r6("mean"), r6("dispersion"), r6("score"), "rank")


def control_features(s, d):
    """Every feature name of the panel and whether its name marks a control."""
    return table(s, d, "gene_panel").select("feature_name", m.is_control(F.col("feature_name")).alias("is_control")).distinct()


def quality_molecules(s, d):
    """Per run: molecules of quality 20 at least that are no control and lie in a cell."""
    t = m.quality_filter(table(s, d, "transcripts"), "qv", "feature_name", "cell_id", 20.0, "is_noise")
    return t.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_molecules"), F.countDistinct("transcript_id").alias("n_ids"), F.round(F.avg("qv"), 6).alias("mean_qv"))


def molecule_centroids(s, d):
    t = table(s, d, "transcripts").select(*RUN, CELL, "x_location", "y_location", "z_location")
    return m.molecule_centroids(t, RUN, CELL, ["x_location", "y_location", "z_location"]).select(*RUN, CELL, "n", *[r6(c) for c in ("x_location", "y_location", "z_location")])


def cells_with_morphology(s, d):
    """Every cell of the count matrix with its centroid and area, nulls where the cell table lacks them."""
    return m.cell_metrics(counts(s, d), RUN, CELL).join(centroids(s, d), [*RUN, CELL], "left").select(*RUN, CELL, "n_counts", "n_genes", r6("x"), r6("y"), "area")


def area_histogram(s, d):
    return m.histogram(table(s, d, "cells").filter("area_px is not null"), RUN, "area_px").select(*RUN, "bin", r6("low"), "n")


def area_summary(s, d):
    return m.five_numbers(table(s, d, "cells"), RUN, "area_px").select(*RUN, "n", *[r6(c) for c in ("least", "q1", "median", "mean", "q3", "most")])


QUERIES = {f.__name__: f for f in (count_matrix_long, count_matrix_wide, matrix_market_triplets, qc_cell_metrics, qc_gene_metrics, qc_min_counts, qc_relaxed_filter, top_gene_cap, adaptive_quantile_qc, pattern_fraction, background_subtract, lognorm, zscore_clip, pearson_residuals, hvg_dispersion, control_features, quality_molecules, molecule_centroids, cells_with_morphology, area_histogram, area_summary)}

CM = ", cm as (select run_id, cell_id, sum(n)::bigint as n_counts, count(*) as n_genes from cnt group by all)\n"
SQL = {
    "count_matrix_long": CNT + "select * from cnt",
    "count_matrix_wide": CNT + """
, p0 as (select feature_name as gene, min(codeword) as o from gene_panel where feature_name is not null group by 1), p as (select gene, row_number() over (order by o, gene) as i from p0),
c as (select run_id, cell_id, sum(n)::bigint as t, sum(case when p.gene is null then n else 0 end)::bigint as n_outside from cnt left join p using (gene) group by all),
a as (select c.run_id, c.cell_id, string_agg(coalesce(cnt.n, 0)::varchar, ',' order by i) as line from c cross join p left join cnt on cnt.run_id = c.run_id and cnt.cell_id = c.cell_id and cnt.gene = p.gene group by all)
select run_id, cell_id, n_outside, line from c join a using (run_id, cell_id)""",
    "control_features": "select distinct feature_name, regexp_matches(lower(feature_name), 'negcontrolprobe|negcontrolcodeword|negprobe|blank|antisense|unassignedcodeword|deprecatedcodeword|intergenic') as is_control from gene_panel",
    "quality_molecules": """
select run_id, count(*) as n_molecules, count(distinct transcript_id) as n_ids, round(avg(qv), 6) as mean_qv from transcripts
where qv >= 20 and not isnan(qv) and cell_id is not null and not regexp_matches(lower(feature_name), 'negcontrolprobe|negcontrolcodeword|negprobe|blank|antisense|unassignedcodeword|deprecatedcodeword|intergenic') group by 1""",
    "molecule_centroids": "select run_id, cell_id, count(*) as n, " + ", ".join(f"round(avg(case when not isnan({c}) then {c} end), 6) as {c}" for c in ("x_location", "y_location", "z_location")) + " from transcripts where cell_id is not null group by all",
    "cells_with_morphology": CNT + CM + ", " + XY + "select cm.run_id, cm.cell_id, n_counts, n_genes, round(x, 6) as x, round(y, 6) as y, area from cm left join xy using (run_id, cell_id)",
    "area_histogram": """
with v as (select run_id, area_px as v from cells where area_px is not null and not isnan(area_px)), e as (select run_id, min(v) as lo, max(v) as hi from v group by 1),
b as (select run_id, lo, (hi - lo) / 50 as w, case when hi > lo then least(floor(round((v - lo) / ((hi - lo) / 50), 9)), 49)::int else 0 end as bin from v join e using (run_id))
select run_id, bin, round(lo + bin * w, 6) as low, count(*) as n from b group by run_id, bin, lo, w""",
    "area_summary": """
select run_id, count(*) as n, round(min(v), 6) as least, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as median, round(avg(v), 6) as mean, round(quantile_cont(v, 0.75), 6) as q3, round(max(v), 6) as most
from (select run_id, area_px as v from cells where area_px is not null and not isnan(area_px)) group by 1""",
    "matrix_market_triplets": CNT + "select dense_rank() over (order by gene) as row, dense_rank() over (order by cell_id) as col, n as value from cnt",
    "qc_cell_metrics": CNT + CM + "select * from cm",
    "qc_gene_metrics": CNT + "select run_id, gene, sum(n)::bigint as n_counts, count(*) as n_cells from cnt group by all",
    "qc_min_counts": CNT + CM + "select run_id, cell_id, n_counts, n_genes from (select *, max(n_counts) over (partition by run_id) as top from cm) where n_counts >= 150 or top < 150",
    "qc_relaxed_filter": CNT + CM + """
, t1(v) as (values (40), (20), (10), (5), (2), (1)), t2(v) as (values (8), (5), (2), (1)),
mg as (select run_id, max(v) as v from (select run_id, max(n_genes) as top from cm group by 1), t1 where v <= top group by 1),
c2 as (select cnt.* from cnt join cm using (run_id, cell_id) join mg using (run_id) where n_genes >= mg.v),
g2 as (select run_id, gene, count(*) as k from c2 group by all),
mc as (select run_id, max(v) as v from (select run_id, max(k) as top from g2 group by 1), t2 where v <= top group by 1)
select c2.run_id, c2.cell_id, c2.gene, c2.n from c2 join g2 using (run_id, gene) join mc using (run_id) where k >= mc.v""",
    "top_gene_cap": CNT + """
, g0 as (select run_id, gene, sum(n) as t from cnt group by all), g as (select run_id, gene, row_number() over (partition by run_id order by t desc, gene) as r from g0)
select run_id, cell_id, gene, n from cnt join g using (run_id, gene) where r <= 5050""",
    "adaptive_quantile_qc": CNT + """
, c as (select run_id, cell_id, sum(n)::bigint as n_counts, count(*) as n_genes, 100.0 * sum(case when gene like 'JUX%' then n else 0 end)::double / sum(n)::double as percent from cnt group by all),
q as (select run_id, quantile_cont(n_genes::double, 0.01) as g1, quantile_cont(n_genes::double, 0.995) as g2, quantile_cont(n_counts::double, 0.01) as c1 from c group by 1)
select run_id, cell_id, n_counts, n_genes, round(percent, 6) as percent from c join q using (run_id)
where n_genes > greatest(10.0, g1) and n_genes < g2 and n_counts > greatest(20.0, c1) and percent < 25""",
    "pattern_fraction": CNT + "select run_id, cell_id, sum(case when gene like 'JUX%' or gene like 'XAZ%' then n else 0 end)::bigint as n_match, round(sum(case when gene like 'JUX%' or gene like 'XAZ%' then n else 0 end)::double / sum(n)::double, 6) as fraction from cnt group by all",
    "background_subtract": CNT + """
, ctl as (select distinct feature_name as gene from gene_panel where feature_class = 'control'),
k as (select run_id, count(distinct gene) as k from cnt where gene in (from ctl) group by 1),
b as (select run_id, cell_id, sum(n) as load from cnt where gene in (from ctl) group by all)
select run_id, cell_id, gene, round(v, 6) as n from (
  select cnt.run_id, cnt.cell_id, cnt.gene, greatest(n - coalesce(load::double / k, 0), 0) as v
  from cnt left join k using (run_id) left join b using (run_id, cell_id) where gene not in (from ctl)) where v > 0""",
    "lognorm": NORM + "select run_id, cell_id, gene, round(x, 6) as x from nrm",
    "zscore_clip": NORM + """
, nc as (select run_id, count(distinct cell_id) as m from cnt group by 1),
g as (select run_id, gene, sum(x) / m as mean, (sum(x * x) - m * (sum(x) / m) ** 2) / (m - 1) as v from nrm join nc using (run_id) group by run_id, gene, m),
s as (select *, case when v > 0 then sqrt(v) else 1 end as sd from g)
select run_id, cell_id, gene, round(greatest(least((x - mean) / sd, 10), -10), 6) as z, round(greatest(least(-mean / sd, 10), -10), 6) as zero from nrm join s using (run_id, gene)""",
    "pearson_residuals": CNT + """
, t as (select run_id, sum(n)::double as t, sqrt(count(distinct cell_id)::double) as b from cnt group by 1),
a as (select *, (sum(n) over (partition by run_id, cell_id))::double * (sum(n) over (partition by run_id, gene))::double as rc from cnt),
r as (select run_id, cell_id, gene, b, (n - rc / t) / sqrt(rc / t + (rc / t) * (rc / t) / 100.0) as v from a join t using (run_id))
select run_id, cell_id, gene, round(greatest(least(v, b), -b), 6) as residual from r""",
    "hvg_dispersion": CNT + """
, y as (select *, n * 1e4 / (sum(n) over (partition by run_id, cell_id))::double as y from cnt),
nc as (select run_id, count(distinct cell_id) as m from cnt group by 1),
g as (select run_id, gene, sum(y) / m as mean, (sum(y * y) - m * (sum(y) / m) ** 2) / (m - 1) as v from y join nc using (run_id) group by run_id, gene, m),
e as (select *, ln(v / mean) as d, ln(1 + mean) as l from g where mean > 0 and v > 0),
w as (select *, min(l) over (partition by run_id) as lo, (max(l) over (partition by run_id) - min(l) over (partition by run_id)) / 20 as wd from e),
b as (select *, case when wd > 0 then least(floor(round((l - lo) / wd, 9)), 19) else 0 end as bin from w),
z as (select *, case when stddev_samp(d) over bw > 1e-12 then (d - avg(d) over bw) / stddev_samp(d) over bw else 1.0 end as score from b window bw as (partition by run_id, bin))
select run_id, gene, round(mean, 6) as mean, round(exp(d), 6) as dispersion, round(score, 6) as score, row_number() over (partition by run_id order by round(score, 9) desc, gene) as rank
from z qualify rank <= 2000""",
}
