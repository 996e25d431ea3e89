"""Cluster statistics and spatial refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import clusters as c
from spotweave.functions.stats import restrict_levels
from spotweave.operators.features import combined_features
from spotweave.operators.knn import knn_plane
from spotweave.operators.skew import exact_quantile
from spotweave.plans.base import LAB, PLANE, RUN, XY, centroids, labels, plane
from spotweave.plans.spatial_queries import e_sql
from spotweave.session import checkpoint, table

CELL = "cell_id"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def points(s, d):
    return plane(s, d).join(labels(s, d), [*RUN, CELL]).select(*RUN, CELL, "cluster", F.array("x", "y").alias("v"))


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def cluster_centroids(s, d):
    return c.vector_means(vectors(s, d), ["label"], "v").select("label", "n", F.posexplode("centre").alias("i", "x")).select("label", "n", "i", *r6("x"))


def cluster_radius(s, d):
    return c.cluster_radii(points(s, d), RUN, "cluster", "v").select(*RUN, "cluster", "n", *r6("radius"))


def centroid_distance(s, d):
    return c.centre_distances(points(s, d), RUN, "cluster", "v").select(*RUN, "a", "b", *r6("distance"))


def silhouette_samples(s, d):
    return c.silhouettes(points(s, d), RUN, CELL, "cluster", "v").select(*RUN, CELL, "cluster", *r6("silhouette"))


def silhouette_by_cluster(s, d):
    t = checkpoint(c.silhouettes(points(s, d), RUN, CELL, "cluster", "v"))
    mean = t.groupBy(*RUN, "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 6).alias("mean"))
    return mean.join(exact_quantile(t, [*RUN, "cluster"], "silhouette", 0.5, "median"), [*RUN, "cluster"], "left").select(*RUN, "cluster", "n", "mean", *r6("median"))


def separability(s, d):
    return c.separability(points(s, d), RUN, CELL, "cluster", "v").select(*RUN, "cluster", "n", *r6("mean_silhouette"), "nearest_cluster", *r6("centroid_dist"))


def merge_clusters(s, d):
    return c.merge_indistinct(points(s, d), RUN, "cluster", "v", 0.9)


def adjusted_rand(s, d):
    t = labels(s, d).join(table(s, d, "umap_clusters_final").groupBy(*RUN, CELL).agg(F.min("cell_type_unsupervised").alias("kind")), [*RUN, CELL])
    return c.rand_index(t, "cluster", "kind").select("n", *r6("ari"))


def small_clusters_to_noise(s, d):
    return c.small_to_noise(labels(s, d), RUN, "cluster", 25).groupBy(*RUN, "cluster").agg(F.count(F.lit(1)).alias("n"))


def _edges(s, d):
    return knn_plane(centroids(s, d), RUN, CELL, "x", "y", 12, include_self=True)


def _posterior(s, d):
    return c.spatial_posterior(points(s, d), _edges(s, d), RUN, CELL, "cluster", "v")


def spatial_posterior(s, d):
    return _posterior(s, d).select(*RUN, CELL, "label", "candidate", *r6("confidence", "entropy", "gain"))


def refine_global(s, d):
    return c.refine_labels(_posterior(s, d), RUN, CELL)


def label_change_audit(s, d):
    t = c.refine_labels(_posterior(s, d), RUN, CELL, revert=1.0)
    return c.label_changes(t, RUN, "label", "refined").select(*RUN, "n", "n_changed", *r6("share_changed"), "clusters_before", "clusters_after")


def roi_components(s, d):
    e = knn_plane(centroids(s, d), RUN, CELL, "x", "y", 10, include_self=True)
    return c.uncertain_regions(_posterior(s, d), e, RUN, CELL).select(*RUN, "region", "size", *r6("density"), "selected")


def entropy_confidence_spearman(s, d):
    t = _posterior(s, d).select(*RUN, F.round("entropy", 6).alias("entropy"), F.round("confidence", 6).alias("confidence"))
    return c.spearman(t, RUN, "entropy", "confidence").select(*RUN, *r6("rho"))


def jaccard_sets(s, d):
    """Published top lists against the currently highest fold changes, as sets of genes for each run."""
    from spotweave.functions.keys import name_key
    from spotweave.operators.markers import best_per_group
    from spotweave.plans.marker_queries import exported

    said = table(s, d, "top10_markers_per_cluster_4").select(*RUN, name_key("gene").alias("gene")).filter("gene is not null")
    true = best_per_group(exported(s, d).filter("logfoldchanges is not null"), [*RUN, "cluster"], F.col("logfoldchanges"), "gene", 10)
    return c.set_overlap(true, said, RUN, "gene").select(*RUN, "n_a", "n_b", "delta", *r6("jaccard"))


def roc_curve(s, d):
    """How well a raised score tells genes of the published lists from the rest, per run."""
    from spotweave.functions.keys import name_key
    from spotweave.plans.marker_queries import exported

    said = table(s, d, "top10_markers_per_cluster_4").select(*RUN, "cluster", name_key("gene").alias("gene")).filter("gene is not null").distinct().withColumn("t", F.lit(True))
    t = exported(s, d).filter("logfoldchanges is not null").join(said, [*RUN, "cluster", "gene"], "left").select(*RUN, F.concat_ws("/", "cluster", "gene").alias("key"), "logfoldchanges", F.coalesce("t", F.lit(False)).alias("t"))
    return c.roc(t, RUN, "logfoldchanges", "t", "key").select(*RUN, *r6("auc"))


def boundary_margin(s, d):
    return c.margins(points(s, d), RUN, CELL, "cluster", "v").select(*RUN, CELL, "cluster", *r6("own", "second", "margin"), "boundary")


def recoded_labels(s, d):
    """Cells of each run by the type that most cells of their cluster have; a cluster without a type is left out of the mapping and becomes null."""
    kinds = table(s, d, "umap_clusters_final").filter("cluster is not null and cell_type_unsupervised is not null").groupBy("cluster", "cell_type_unsupervised").agg(F.count(F.lit(1)).alias("n"))
    best = kinds.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "cell_type_unsupervised")).alias("m")).select("cluster", F.col("m.cell_type_unsupervised").alias("kind"))
    return c.recode(labels(s, d), "cluster", best, "cluster", "kind").groupBy(*RUN, F.col("cluster").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def document_levels(s, d):
    """Documents by language, a missing one filled in and all but three levels set to null."""
    lang = restrict_levels(F.coalesce("lang", F.lit("en")), ["de", "en", "fr"])
    return table(s, d, "documents").groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def uncertain_parts(s, d):
    """Connected regions of high entropy with their size and density."""
    e = knn_plane(centroids(s, d), RUN, CELL, "x", "y", 10, include_self=True)
    return c.uncertain_regions(_posterior(s, d), e, RUN, CELL).select(*RUN, "region", "size", *r6("density"))


def _chosen(s, d):
    post = checkpoint(_posterior(s, d))
    e = knn_plane(centroids(s, d), RUN, CELL, "x", "y", 10, include_self=True)
    members = c.region_members(post, e, RUN, CELL)
    return post, c.choose_mode(points(s, d), post, c.uncertain_regions(post, e, RUN, CELL), members, RUN, CELL, "cluster", "v")


def refined_labels(s, d):
    """Labels refined everywhere or in uncertain regions only, whichever scores higher in a run."""
    return _chosen(s, d)[1]


def posterior_table(s, d):
    """The exported posterior table: entropy and confidence of each cell, whether it lies in a selected region, and whether its label changed."""
    post, t = _chosen(s, d)
    t = t.select(*RUN, CELL, F.col("in_roi").cast("int").alias("in_roi"), (F.col("label") != F.col("refined")).cast("int").alias("updated"))
    return post.select(*RUN, CELL, *r6("entropy", "confidence")).join(t, [*RUN, CELL])


def spatial_cluster_table(s, d):
    """The exported table of cells with cluster, type and centroid."""
    kind = table(s, d, "umap_clusters_final").groupBy(*RUN, CELL).agg(F.min("cell_type_unsupervised").alias("cell_type_unsupervised"))
    return labels(s, d).join(kind, [*RUN, CELL]).join(centroids(s, d).select(*RUN, CELL, F.col("x").alias("x_centroid_px"), F.col("y").alias("y_centroid_px")), [*RUN, CELL])


def layout_cluster_table(s, d):
    """The exported table of layout points with cluster and type."""
    kind = table(s, d, "umap_clusters_final").groupBy(*RUN, CELL).agg(F.min("cell_type_unsupervised").alias("cell_type_unsupervised"))
    return plane(s, d).join(labels(s, d), [*RUN, CELL]).join(kind, [*RUN, CELL]).select(*RUN, CELL, *[F.round(k, 5).alias(n) for k, n in (("x", "umap1"), ("y", "umap2"))], "cluster", "cell_type_unsupervised")


def sweep_metrics(s, d):
    """One row of quality metrics for each run: cells, clusters, size-weighted silhouette, counts per cell, marker strength and specificity."""
    from spotweave.operators.latest import latest_rows
    from spotweave.operators.matrix import cell_metrics
    from spotweave.functions.keys import name_key, null_if_bad
    from spotweave.plans.base import counts

    sep = c.silhouettes(points(s, d), RUN, CELL, "cluster", "v").groupBy(*RUN, "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("m"))
    sep = sep.groupBy(*RUN).agg(F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_clusters"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("weighted_silhouette"))
    n = checkpoint(cell_metrics(counts(s, d), RUN, CELL))
    per = exact_quantile(n, RUN, "n_counts", 0.5, "median_counts_per_cell").join(n.groupBy(*RUN).agg(F.avg("n_counts").alias("mean_counts_per_cell")), RUN)
    m = table(s, d, "cluster_markers_all_cells_final").withColumn("gene", name_key("names")).filter("gene is not null and gene <> '(CLUSTER TOO SMALL)'")
    columns = ["logfoldchanges", "pvals_adj", "pct_nz_group", "pct_nz_reference"]
    m = latest_rows(m, [*RUN, "cluster", "gene"], "exported_at", columns).select(*RUN, *[null_if_bad(k).alias(k) for k in columns])
    m = checkpoint(m.filter("pvals_adj < 0.05 and logfoldchanges > 0"))
    mark = exact_quantile(m, RUN, "logfoldchanges", 0.5, "median_log2fc").join(m.groupBy(*RUN).agg(F.avg(F.col("pct_nz_group") - F.col("pct_nz_reference")).alias("mean_specificity")), RUN)
    return sep.join(per, RUN).join(mark, RUN, "left").select(*RUN, "n_cells", "n_clusters", *r6("weighted_silhouette", "median_counts_per_cell", "mean_counts_per_cell", "median_log2fc", "mean_specificity"))


def latent_blocks(s, d):
    """Standardised blocks of latent position, sharpened soft labels, centroid and density, weighted and standardised once more."""
    t = points(s, d).select(*RUN, CELL, "v").join(centroids(s, d).select(*RUN, CELL, "x", "y"), [*RUN, CELL])
    return combined_features(t, RUN, CELL, "v", "x", "y", 15).select(*RUN, CELL, F.posexplode("features").alias("i", "value")).select(*RUN, CELL, "i", *r6("value"))


QUERIES = {f.__name__: f for f in (cluster_centroids, cluster_radius, centroid_distance, silhouette_samples, silhouette_by_cluster, separability, merge_clusters, adjusted_rand, small_clusters_to_noise, spatial_posterior, refine_global, label_change_audit, roi_components, entropy_confidence_spearman, jaccard_sets, roc_curve, boundary_margin, recoded_labels, document_levels, uncertain_parts, refined_labels, posterior_table, spatial_cluster_table, layout_cluster_table, sweep_metrics, latent_blocks)}

PTS = "with " + PLANE + ", " + LAB + ", pt as (select run_id, cell_id, cluster, x, y from pl join lab using (run_id, cell_id)), ce as (select run_id, cluster, avg(x) as cx, avg(y) as cy, count(*) as n from pt group by all)\n"
def sil_sql(points: str, tag: str = "") -> str:
    """CTEs of the silhouettes of a table (run_id, cell_id, cluster, x, y), by comparing all points of a run; the last is si."""
    return f"""
, dd{tag} as (select a.run_id, a.cell_id, a.cluster, b.cluster as oc, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as t, count(*) as k from {points} a join {points} b using (run_id) group by all),
ab{tag} as (select run_id, cell_id, cluster, max(case when cluster = oc then k end) as own, max(case when cluster = oc and k > 1 then t / (k - 1) end) as a, min(case when cluster <> oc then t / k end) as b from dd{tag} group by all),
si{tag} as (select run_id, cell_id, cluster, case when b is null then null when own = 1 then 0 else (b - a) / greatest(a, b) end as silhouette from ab{tag})
"""


SIL = PTS + sil_sql("pt")
POST = PTS + ", " + XY + ", " + e_sql(12, True) + """
, kk as (select run_id, count(*) as k from ce group by 1),
vt as (select e.run_id, src, pt.cluster as c, count(*) as v from e join pt on pt.run_id = e.run_id and pt.cell_id = e.dst group by all),
lg as (select pt.run_id, pt.cell_id, pt.cluster as label, ce.cluster as c, -sqrt((x - cx) ** 2 + (y - cy) ** 2) + least(1.2, 0.3 + ln(1 + k)) * coalesce(v, 0) as l
       from pt join ce using (run_id) join kk using (run_id) left join vt on vt.run_id = pt.run_id and vt.src = pt.cell_id and vt.c = ce.cluster),
ex as (select *, exp(l - max(l) over (partition by run_id, cell_id)) as x from lg),
pp as (select *, x / sum(x) over (partition by run_id, cell_id) as p from ex),
po as (select run_id, cell_id, label, arg_max(c, struct_pack(a := round(p, 12), b := -ord(c))) as candidate, max(p) as confidence, -sum(p * ln(p + 1e-12)) as entropy, max(p) - max(case when c = label then p end) as gain from pp group by all)
"""
REFINING = """
, f as (select *, round(confidence, 9) > 0.6 and round(gain, 9) > 0 and candidate <> label as f, count(*) over (partition by run_id) as n from po),
r as (select *, f and row_number() over (partition by run_id, f order by round(confidence, 9) desc, cell_id) <= floor(n * 0.5) as ok from f),
sh as (select *, avg(ok::int) over (partition by run_id) as share from r)
"""
REF = POST + REFINING
PARTS = "with recursive " + POST.strip()[len("with "):] + ", " + e_sql(10, True, "w") + """
, q as (select run_id, quantile_cont(entropy, 0.75) as c from po group by 1), h as (select po.run_id, cell_id, entropy from po join q using (run_id) where round(entropy, 9) >= round(c, 9)),
li as (select w.run_id, src as a, dst as b from w join h x on x.run_id = w.run_id and x.cell_id = src join h y on y.run_id = w.run_id and y.cell_id = dst),
lk as (select run_id, a, b from li union select run_id, b, a from li),
reach(run_id, a, b) as (select run_id, cell_id, cell_id from h union select r.run_id, r.a, lk.b from reach r join lk on lk.run_id = r.run_id and lk.a = r.b),
g as (select run_id, a as cell_id, min(b) as region from reach group by all),
rg0 as (select run_id, region, count(*) as size, avg(entropy) / count(*) as density from g join h using (run_id, cell_id) group by all),
rg as (select *, row_number() over (partition by run_id order by round(density, 9) desc, region) as o from rg0)
"""
CHOSEN = PARTS + """
, walk(run_id, o, room, selected) as (select run_id, 0::bigint, 0.25::double * count(*), false from po group by run_id
  union all select k.run_id, rg.o, case when rg.size <= k.room then k.room - rg.size else k.room end, rg.size <= k.room from walk k join rg on rg.run_id = k.run_id and rg.o = k.o + 1)
"""
MODES = CHOSEN + REFINING + """
, z as (select run_id, cell_id, label, case when ok and share <= 0.3 then candidate else label end as refined from sh),
inn as (select g.run_id, g.cell_id, true as inn from g join rg using (run_id, region) join walk k using (run_id, o) where k.selected),
lb as (select z.run_id, z.cell_id, label, refined, inn is not null as in_roi, case when inn then refined else label end as roi from z left join inn using (run_id, cell_id)),
pa as (select run_id, cell_id, refined as cluster, x, y from lb join pl using (run_id, cell_id)), pb as (select run_id, cell_id, roi as cluster, x, y from lb join pl using (run_id, cell_id))
""" + sil_sql("pa", "_a") + sil_sql("pb", "_b") + """
, sa as (select run_id, avg(silhouette) as s from si_a group by 1), sb as (select run_id, avg(silhouette) as s from si_b group by 1),
md as (select run_id, case when round(coalesce(sb.s, 0), 9) > round(coalesce(sa.s, 0), 9) then 'ROI' else 'GLOBAL' end as mode from sa join sb using (run_id)),
fin as (select run_id, cell_id, label, case when mode = 'ROI' then roi else refined end as refined, mode, in_roi from lb join md using (run_id))
"""
SQL = {
    "cluster_centroids": "with p as (select label, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from embeddings) select label::varchar as label, count(*) as n, i::int as i, round(avg(x), 6) as x from p group by label, i",
    "cluster_radius": PTS + "select run_id, cluster, count(*) as n, round(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)), 6) as radius from pt join ce using (run_id, cluster) group by all",
    "centroid_distance": PTS + "select a.run_id, a.cluster as a, b.cluster as b, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 6) as distance from ce a join ce b on a.run_id = b.run_id and a.cluster <> b.cluster",
    "silhouette_samples": SIL + "select run_id, cell_id, cluster, round(silhouette, 6) as silhouette from si",
    "silhouette_by_cluster": SIL + "select run_id, cluster, count(*) as n, round(avg(silhouette), 6) as mean, round(median(silhouette), 6) as median from si group by all",
    "separability": SIL + """
, nr as (select a.run_id, a.cluster, min({'d': sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 'b': b.cluster}) as m from ce a join ce b on a.run_id = b.run_id and a.cluster <> b.cluster group by all)
select run_id, cluster, count(*) as n, round(avg(silhouette), 6) as mean_silhouette, any_value(m.b) as nearest_cluster, round(any_value(m.d), 6) as centroid_dist from si left join nr using (run_id, cluster) group by all""",
    "adjusted_rand": "with " + LAB + """
, k as (select run_id, cell_id, min(cell_type_unsupervised) as kind from umap_clusters_final group by all),
t as (select cluster as a, kind as b, count(*)::double as n from lab join k using (run_id, cell_id) where kind is not null group by all),
x as (select sum(n * (n - 1) / 2) as ij, sum(n) as total from t), ra as (select sum(n * (n - 1) / 2) as ai from (select sum(n) as n from t group by a)), rb as (select sum(n * (n - 1) / 2) as bj from (select sum(n) as n from t group by b))
select total::bigint as n, round((ij - ai * bj / (total * (total - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (total * (total - 1) / 2)), 6) as ari from x, ra, rb""",
    "small_clusters_to_noise": "with " + LAB + ", n as (select *, count(*) over (partition by run_id, cluster) as k from lab) select run_id, case when k < 25 then 'noise' else cluster end as cluster, count(*) as n from n group by all",
    "spatial_posterior": POST + "select run_id, cell_id, label, candidate, round(confidence, 6) as confidence, round(entropy, 6) as entropy, round(gain, 6) as gain from po",
    "refine_global": REF + "select run_id, cell_id, label, case when ok and share <= 0.3 then candidate else label end as refined from sh",
    "label_change_audit": REF + """
, z as (select run_id, label, case when ok then candidate else label end as refined from sh)
select run_id, count(*) as n, sum((label <> refined)::int)::bigint as n_changed, round(avg((label <> refined)::int), 6) as share_changed, count(distinct label) as clusters_before, count(distinct refined) as clusters_after from z group by 1""",
    "entropy_confidence_spearman": POST + """
, q as (select run_id, round(entropy, 6) as a, round(confidence, 6) as b from po),
r as (select run_id, rank() over (partition by run_id order by a) + (count(*) over (partition by run_id, a) - 1) / 2.0::double as ra, rank() over (partition by run_id order by b) + (count(*) over (partition by run_id, b) - 1) / 2.0::double as rb from q)
select run_id, round(corr(ra, rb), 6) as rho from r group by 1""",
    "jaccard_sets": """__EXP__
, t as (select distinct run_id, gene from (select run_id, gene, row_number() over (partition by run_id, cluster order by lfc desc, gene) as rn from e where lfc is not null) where rn <= 10),
s as (select distinct run_id, upper(trim(gene)) as gene from top10_markers_per_cluster_4 where gene is not null),
j as (select coalesce(t.run_id, s.run_id) as run_id, t.gene as a, s.gene as b from t full join s on t.run_id = s.run_id and t.gene = s.gene)
select run_id, count(a) as n_a, count(b) as n_b, count(b) - count(a) as delta, round(count(case when a = b then 1 end) / count(*), 6) as jaccard from j group by 1""",
    "roc_curve": """__EXP__
, s as (select distinct run_id, cluster, upper(trim(gene)) as gene from top10_markers_per_cluster_4 where gene is not null),
t as (select e.run_id, e.cluster || '/' || e.gene as key, lfc, (s.gene is not null)::int as t from e left join s on s.run_id = e.run_id and s.cluster = e.cluster and s.gene = e.gene where lfc is not null),
u as (select *, sum(t) over (partition by run_id order by lfc desc, key rows unbounded preceding) as tp from t)
select run_id, round(sum((1 - t) * tp)::double / (sum(t)::double * sum(1 - t)::double), 6) as auc from u group by 1""",
    "boundary_margin": PTS + """
, ds as (select pt.run_id, pt.cell_id, pt.cluster, list_sort(list(sqrt((x - cx) ** 2 + (y - cy) ** 2))) as l, min(case when pt.cluster = ce.cluster then sqrt((x - cx) ** 2 + (y - cy) ** 2) end) as own from pt join ce using (run_id) group by all),
mg as (select run_id, cell_id, cluster, own, l[2] as second, l[2] - own as margin from ds), q as (select run_id, quantile_cont(margin, 0.35) as c from mg group by 1)
select run_id, cell_id, cluster, round(own, 6) as own, round(second, 6) as second, round(margin, 6) as margin, round(margin, 9) < round(c, 9) as boundary from mg join q using (run_id)""",
    "recoded_labels": "with " + LAB + """
, k as (select cluster, cell_type_unsupervised as kind, count(*) as n from umap_clusters_final where cluster is not null and cell_type_unsupervised is not null group by all),
b as (select cluster, kind from k qualify row_number() over (partition by cluster order by n desc, kind) = 1)
select run_id, kind, count(*) as n from lab left join b using (cluster) group by all""",
    "document_levels": "select case when coalesce(lang, 'en') in ('de', 'en', 'fr') then coalesce(lang, 'en') end as lang, count(*) as n from documents group by 1",
    "uncertain_parts": PARTS + "select run_id, region, size, round(density, 6) as density from rg",
    "roi_components": CHOSEN + "select rg.run_id, region, size, round(density, 6) as density, k.selected from rg join walk k using (run_id, o)",
    "refined_labels": MODES + "select * from fin",
    "posterior_table": MODES + "select run_id, cell_id, round(entropy, 6) as entropy, round(confidence, 6) as confidence, in_roi::int as in_roi, (fin.label <> refined)::int as updated from po join fin using (run_id, cell_id)",
    "spatial_cluster_table": "with " + LAB + ", " + XY + """
, k as (select run_id, cell_id, min(cell_type_unsupervised) as cell_type_unsupervised from umap_clusters_final group by all)
select run_id, cell_id, cluster, cell_type_unsupervised, x as x_centroid_px, y as y_centroid_px from lab join k using (run_id, cell_id) join xy using (run_id, cell_id)""",
    "layout_cluster_table": PTS + """
, k as (select run_id, cell_id, min(cell_type_unsupervised) as cell_type_unsupervised from umap_clusters_final group by all)
select run_id, cell_id, round(x, 5) as umap1, round(y, 5) as umap2, cluster, cell_type_unsupervised from pt join k using (run_id, cell_id)""",
    "sweep_metrics": SIL + """
, sp as (select run_id, cluster, count(*) as n, avg(silhouette) as m from si group by all), sw as (select run_id, sum(n)::bigint as n_cells, count(*) as n_clusters, sum(n * m)::double / sum(n)::double as weighted_silhouette from sp group by 1),
l as (select transcript_id, arg_max(struct_pack(run_id := run_id, x := x_location, y := y_location, cell_id := cell_id, f := feature_name),
        struct_pack(t := loaded_at, a := run_id, b := coalesce(x_location, '-infinity'::double), c := coalesce(y_location, '-infinity'::double), e := coalesce(cell_id, ''), f := coalesce(feature_name, ''))) as s from transcripts group by 1),
cc as (select s.run_id as run_id, s.cell_id as cell_id, count(*) as n from l where s.x is not null and s.y is not null and not isnan(s.x) and not isnan(s.y) and trim(s.f) <> ''
         and exists (select 1 from cells c where c.run_id = s.run_id and c.cell_id = s.cell_id) group by all),
cs as (select run_id, median(n) as median_counts_per_cell, avg(n) as mean_counts_per_cell from cc group by 1),
mx as (select run_id, cluster, upper(trim(names)) as gene, arg_max(struct_pack(a := logfoldchanges, c := pvals_adj, g := pct_nz_group, h := pct_nz_reference),
         struct_pack(t := exported_at, a := coalesce(logfoldchanges, '-infinity'::double), c := coalesce(pvals_adj, '-infinity'::double), g := coalesce(pct_nz_group, '-infinity'::double), h := coalesce(pct_nz_reference, '-infinity'::double))) as s
       from cluster_markers_all_cells_final where names is not null and upper(trim(names)) <> '(CLUSTER TOO SMALL)' group by all),
ms as (select run_id, median(s.a) as median_log2fc, avg(case when isfinite(s.g) and isfinite(s.h) then s.g - s.h end) as mean_specificity from mx where s.a > 0 and isfinite(s.a) and s.c < 0.05 and isfinite(s.c) group by 1)
select run_id, n_cells, n_clusters, round(weighted_silhouette, 6) as weighted_silhouette, round(median_counts_per_cell, 6) as median_counts_per_cell, round(mean_counts_per_cell, 6) as mean_counts_per_cell, round(median_log2fc, 6) as median_log2fc, round(mean_specificity, 6) as mean_specificity
from sw join cs using (run_id) left join ms using (run_id)""",
    "latent_blocks": PTS + ", " + XY + """
, b0 as (select pt.run_id, pt.cell_id, pt.x as a, pt.y as b, xy.x as x, xy.y as y from pt join xy using (run_id, cell_id)),
dn0 as (select p.run_id, p.cell_id, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) as dist from b0 p join b0 q using (run_id) qualify row_number() over (partition by p.run_id, p.cell_id order by (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b), q.cell_id) <= 15),
dn1 as (select run_id, cell_id, 1.0 / (avg(dist) + 1e-8) as raw from dn0 group by all),
dn as (select run_id, cell_id, (raw - avg(raw) over w) / case when stddev_pop(raw) over w > 0 then stddev_pop(raw) over w else 1 end as d from dn1 window w as (partition by run_id)),
f0 as (select b0.*, exp(1.5 * (a - greatest(a, b))) as ea, exp(1.5 * (b - greatest(a, b))) as eb, d from b0 join dn using (run_id, cell_id)),
f1 as (select run_id, cell_id, 1.5 * (a - avg(a) over w) / (stddev_pop(a) over w) as f0, 1.5 * (b - avg(b) over w) / (stddev_pop(b) over w) as f1, 0.8 * ea / (ea + eb) as f2, 0.8 * eb / (ea + eb) as f3,
         0.35 * (x - avg(x) over w) / (stddev_pop(x) over w) as f4, 0.35 * (y - avg(y) over w) / (stddev_pop(y) over w) as f5, 0.25 * d as f6 from f0 window w as (partition by run_id)),
u as (""" + " union all ".join(f"select run_id, cell_id, {i} as i, f{i} as v from f1" for i in range(7)) + """)
select run_id, cell_id, i::int as i, round((v - avg(v) over w) / case when stddev_pop(v) over w > 1e-12 then stddev_pop(v) over w else 1 end, 6) as value from u window w as (partition by run_id, i)""",
}


def _fill() -> None:
    from spotweave.plans.marker_queries import EXP

    for k in ("jaccard_sets", "roc_curve"):
        SQL[k] = SQL[k].replace("__EXP__", EXP)


_fill()
