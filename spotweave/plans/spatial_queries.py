"""Neighbour graphs and the statistics on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions.stats import unit
from spotweave.operators import spatial as sp
from spotweave.operators.knn import knn_plane, knn_vectors, local_density as density
from spotweave.operators.markers import adjust_bh, two_sided_p
from spotweave.operators.matrix import normalised
from spotweave.plans.base import CNT, LAB, NORM, RUN, XY, centroids, counts, labels, tail_sql
from spotweave.session import checkpoint, table

CELL, GENE = "cell_id", "gene"


#: Replicates of the bootstrap.
REPLICATES = 1000


def edges(s, d, k, include_self=False):
    return knn_plane(centroids(s, d), RUN, CELL, "x", "y", k, include_self)


def knn_edges(s, d):
    return edges(s, d, 6).select(*RUN, "src", "dst", "rank", F.round("dist", 6).alias("dist"))


def knn_edges_with_self(s, d):
    return edges(s, d, 12, include_self=True).select(*RUN, "src", "dst", "rank", F.round("dist", 6).alias("dist"))


def knn_embedding(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return knn_vectors(e, e.filter("vec_id % 20 = 0"), "vec_id", "v", 10, cosine=True).select("src", "dst", "rank", F.round("dist", 6).alias("dist"))


def local_density(s, d):
    return density(edges(s, d, 15, include_self=True), RUN).select(*RUN, "src", F.round("density", 6).alias("density"))


def neighbour_majority(s, d):
    m = sp.majority_label(edges(s, d, 10, include_self=True), labels(s, d), RUN, CELL, "cluster")
    return m.select(*RUN, "src", "label", "votes", F.round("share", 6).alias("share"))


def spatial_denoise(s, d):
    c = labels(s, d).join(centroids(s, d).select(*RUN, CELL, "area"), [*RUN, CELL]).filter("area is not null")
    return sp.denoise_labels(edges(s, d, 15), c, RUN, CELL, "cluster", "area")


def local_shannon(s, d):
    return sp.label_diversity(edges(s, d, 50), labels(s, d), RUN, CELL, "cluster").select(*RUN, "src", F.round("entropy", 6).alias("entropy"))


def diversity_hotspots(s, d):
    return sp.hotspots(sp.label_diversity(edges(s, d, 50), labels(s, d), RUN, CELL, "cluster"), RUN, "entropy").select(*RUN, "src", F.round("entropy", 6).alias("entropy"))


def _moran(s, d):
    c = centroids(s, d)
    return sp.morans_i(normalised(counts(s, d), RUN, CELL), edges(s, d, 6), c, RUN, CELL, GENE, "x")


def moran_i(s, d):
    return _moran(s, d).select(*RUN, GENE, *[F.round(c, 6).alias(c) for c in ("moran", "expected", "variance", "z")])


def spatial_magnitude(s, d):
    m = _moran(s, d).withColumn("p", F.when(F.col("z") > 0, two_sided_p("z") / 2).otherwise(1 - two_sided_p("z") / 2))
    m = adjust_bh(m, RUN, "p", "q", GENE).withColumn("sig", F.col("q") < 0.05)
    return sp.spatial_magnitude(m, RUN, "moran", "sig").select(*RUN, *[F.round(c, 6).alias(c) for c in ("median_moran", "mean_moran", "pct_sig", "magnitude")])


def _pairs(s, d):
    c, e, n = centroids(s, d), edges(s, d, 6), counts(s, d)
    both = [sp.morans_i(v, e, c, RUN, CELL, GENE, x).select(*RUN, GENE, F.lit(m).alias("method"), F.round("moran", 9).alias("moran")) for m, v, x in (("lognorm", normalised(n, RUN, CELL), "x"), ("raw", n, "n"))]
    return sp.paired_complete(both[0].unionByName(both[1]), [*RUN, GENE], "method", "moran", ["lognorm", "raw"])


def paired_genes(s, d):
    return _pairs(s, d).select(*RUN, GENE, F.round("lognorm", 6).alias("lognorm"), F.round("raw", 6).alias("raw"))


def paired_bootstrap(s, d):
    b = sp.bootstrap_medians(_pairs(s, d), RUN, GENE, ["lognorm", "raw"], REPLICATES)
    diff = F.col("lognorm") - F.col("raw")
    q = lambda c, p: F.percentile(c, F.lit(p))
    one = b.withColumn("diff", diff).groupBy(*RUN).agg(*[q(c, p).alias(f"{c}_{n}") for c in ("lognorm", "raw", "diff") for n, p in (("low", 0.025), ("high", 0.975))], F.avg((F.col("diff") <= 0).cast("double")).alias("below"))
    two = F.greatest(2 * F.least("below", 1 - F.col("below")), F.lit(1 / REPLICATES))
    return one.select(*RUN, *[F.round(f"{c}_{n}", 6).alias(f"{c}_{n}") for c in ("lognorm", "raw", "diff") for n in ("low", "high")], F.round(two, 6).alias("p"))


def bootstrap_verdicts(s, d):
    """Which of the two values shows more spatial structure, per run."""
    t = sp.bootstrap_verdicts(_pairs(s, d), RUN, GENE, ["lognorm", "raw"], REPLICATES)[1]
    return t.select(*RUN, "method_a", "method_b", *[F.round(c, 6).alias(c) for c in ("diff", "ci_low", "ci_high", "p", "p_adj")], "verdict")


def bootstrap_intervals(s, d):
    """Median Moran's I of each value with its interval, largest first."""
    t = sp.bootstrap_verdicts(_pairs(s, d), RUN, GENE, ["lognorm", "raw"], REPLICATES)[0]
    return t.select(*RUN, "method", *[F.round(c, 6).alias(c) for c in ("observed", "ci_low", "ci_high")], "place")


def permuted_moran(s, d):
    """Moran's I after the cells of a run have changed places: the null of moran_i."""
    c = sp.permuted_cells(centroids(s, d).select(*RUN, CELL, "x", "y"), RUN, CELL, ["x", "y"])
    c = checkpoint(c)
    t = sp.morans_i(normalised(counts(s, d), RUN, CELL), knn_plane(c, RUN, CELL, "x", "y", 6), c, RUN, CELL, GENE, "x")
    return t.select(*RUN, GENE, *[F.round(k, 6).alias(k) for k in ("moran", "expected", "variance", "z")])


def paga_connectivity(s, d):
    """Observed over expected edges between clusters."""
    e = edges(s, d, 6)
    l = labels(s, d)
    a, b = (l.select(*RUN, F.col(CELL).alias(k), F.col("cluster").alias(f"{k}_cluster")) for k in ("src", "dst"))
    t = e.join(a, [*RUN, "src"]).join(b, [*RUN, "dst"]).groupBy(*RUN, "src_cluster", "dst_cluster").agg(F.count(F.lit(1)).alias("n_edges"))
    from pyspark.sql import Window

    total = lambda *k: F.sum("n_edges").over(Window.partitionBy(*RUN, *k))
    return t.withColumn("connectivity", F.round(F.col("n_edges") * total() / (total("src_cluster") * total("dst_cluster")), 6))


def unit_embeddings(s, d):
    e = table(s, d, "embeddings").select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("v"))
    return e.select("vec_id", F.posexplode("v")).groupBy("pos").agg(F.round(F.avg("col"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (knn_edges, knn_edges_with_self, knn_embedding, local_density, neighbour_majority, spatial_denoise, local_shannon, diversity_hotspots, moran_i, spatial_magnitude, paired_genes, paired_bootstrap, bootstrap_verdicts, bootstrap_intervals, permuted_moran, paga_connectivity, unit_embeddings)}


def e_sql(k: int, own: bool = False, name: str = "e") -> str:
    """CTE of the k nearest cells by comparing all cells of a run; needs xy."""
    return f"""{name}0 as (select a.run_id, a.cell_id as src, b.cell_id as dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2 from xy a join xy b on a.run_id = b.run_id {'' if own else 'and a.cell_id <> b.cell_id'}),
{name} as (select run_id, src, dst, sqrt(d2) as dist, row_number() over (partition by run_id, src order by d2, dst) as rank from {name}0 qualify rank <= {k})
"""


MORAN = """
, dg as (select run_id, src, dst, 1.0 / count(*) over (partition by run_id, src) as w from e),
nn as (select run_id, count(*)::double as n from xy group by 1),
s0 as (select run_id, sum(w) as s0 from dg group by 1),
s1 as (select coalesce(a.run_id, b.run_id) as run_id, sum((coalesce(a.w, 0) + coalesce(b.w, 0)) ** 2) / 2 as s1 from dg a full join (select run_id, dst as src, src as dst, w from dg) b on a.run_id = b.run_id and a.src = b.src and a.dst = b.dst group by 1),
s2 as (select run_id, sum(t) as s2 from (select run_id, c, sum(w) ** 2 as t from (select run_id, src as c, w from dg union all select run_id, dst, w from dg) group by all) group by 1)
"""


def moran_sql(values: str, x: str, name: str) -> str:
    """CTE of Moran's I by filling in every zero; needs xy and MORAN's tables."""
    return f"""
, {name}g as (select run_id, gene from (select v.run_id, v.gene from {values} v join xy using (run_id, cell_id)) group by all having count(*) >= 10),
{name}f as (select g.run_id, g.gene, c.cell_id, coalesce(v.{x}, 0)::double as x from {name}g g join xy c using (run_id) left join {values} v on v.run_id = g.run_id and v.gene = g.gene and v.cell_id = c.cell_id),
{name}z as (select *, x - avg(x) over (partition by run_id, gene) as z from {name}f),
{name}m as (select run_id, gene, sum(z * z) as v2, sum(z ** 4) as v4 from {name}z group by all having sum(z * z) > 1e-12),
{name}c as (select a.run_id, a.gene, sum(w * a.z * b.z) as zz from dg join {name}z a on a.run_id = dg.run_id and a.cell_id = dg.src join {name}z b on b.run_id = dg.run_id and b.cell_id = dg.dst and b.gene = a.gene group by all),
{name} as (select m.run_id, m.gene, n / s0 * zz / v2 as moran, -1 / (n - 1) as expected,
  (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - n * v4 / (v2 * v2) * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1) * (n - 1)) as variance
  from {name}m m join {name}c using (run_id, gene) join nn using (run_id) join s0 using (run_id) join s1 using (run_id) join s2 using (run_id))
"""


VOTES = ", v as (select e.run_id, src, cluster as label, count(*) as votes from e join lab on lab.run_id = e.run_id and lab.cell_id = e.dst group by all)\n"
ENT = VOTES + ", h as (select run_id, src, -sum(p * ln(p)) as entropy from (select *, votes / (sum(votes) over (partition by run_id, src))::double as p from v) group by all)\n"
DENOISE = "with " + XY + ", " + LAB + ", " + e_sql(15) + """
, s0 as (select run_id, cell_id, cluster as label, area as c from lab join xy using (run_id, cell_id) where area is not null),
ct as (select run_id, median(c) as cut from s0 group by 1)
""" + "".join(f"""
, v{i} as (select e.run_id, src, label, count(*) as votes from e join s{i} s on s.run_id = e.run_id and s.cell_id = e.dst group by all),
m{i} as (select *, votes / (sum(votes) over (partition by run_id, src))::double as share, row_number() over (partition by run_id, src order by votes desc, label) as r from v{i}),
s{i + 1} as (select s.run_id, s.cell_id, case when c <= cut and share >= 0.65 then m.label else s.label end as label, c from s{i} s join ct using (run_id) left join m{i} m on m.run_id = s.run_id and m.src = s.cell_id and m.r = 1)
""" for i in range(2)) + "select run_id, cell_id, label from s2"
PAIRS = NORM + ", " + XY + ", " + e_sql(6) + MORAN + moran_sql("nrm", "x", "mi") + moran_sql("cnt", "n", "mr") + ", pr as (select run_id, gene, round(mi.moran, 9) as lognorm, round(mr.moran, 9) as raw from mi join mr using (run_id, gene))\n"

BOOT = PAIRS + """
, rw as (select *, row_number() over (partition by run_id order by gene) - 1 as pos from pr),
sz as (select run_id, count(*) as n, median(lognorm) as sl, median(raw) as sr from pr group by 1),
dr as (select run_id, b, ('0x' || substr(md5('1_' || b || '_' || i), 1, 8))::bigint % n as pos from (select run_id, n, unnest(range(1, 1001)) as b from sz), lateral (select unnest(range(1, n + 1)) as i)),
bt as (select run_id, b, median(lognorm) as lognorm, median(raw) as raw from dr join rw using (run_id, pos) group by all),
bq as (select run_id, any_value(sl) as sl, any_value(sr) as sr, quantile_cont(lognorm, 0.025) as l0, quantile_cont(lognorm, 0.975) as l1, quantile_cont(raw, 0.025) as r0, quantile_cont(raw, 0.975) as r1,
         quantile_cont(lognorm - raw, 0.025) as d0, quantile_cont(lognorm - raw, 0.975) as d1, least(greatest(2 * least(avg((lognorm - raw <= 0)::int), avg((lognorm - raw >= 0)::int)), 0.001), 1) as p from bt join sz using (run_id) group by 1)
"""
SQL = {
    "bootstrap_verdicts": BOOT + """
select run_id, 'lognorm' as method_a, 'raw' as method_b, round(sl - sr, 6) as diff, round(d0, 6) as ci_low, round(d1, 6) as ci_high, round(p, 6) as p, round(p, 6) as p_adj,
  case when (round(d0, 12) > 0 or round(d1, 12) < 0) and sl > sr then 'lognorm > raw' when (round(d0, 12) > 0 or round(d1, 12) < 0) and sl < sr then 'raw > lognorm' else 'tie (CI spans 0)' end as verdict from bq""",
    "bootstrap_intervals": BOOT + """
, u as (select run_id, 'lognorm' as method, sl as observed, l0 as ci_low, l1 as ci_high from bq union all select run_id, 'raw', sr, r0, r1 from bq)
select run_id, method, round(observed, 6) as observed, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, row_number() over (partition by run_id order by round(observed, 9) desc, method) as place from u""",
    "permuted_moran": NORM + ", " + XY.replace("xy as", "xy0 as") + """
, ih as (select run_id, x, y, area, row_number() over (partition by run_id order by ('0x' || substr(md5('1_' || cell_id), 1, 8))::bigint, cell_id) as i from xy0),
ic as (select run_id, cell_id, row_number() over (partition by run_id order by cell_id) as i from xy0), xy as (select run_id, cell_id, x, y, area from ic join ih using (run_id, i))
, """ + e_sql(6) + MORAN + moran_sql("nrm", "x", "mi") + "select run_id, gene, round(moran, 6) as moran, round(expected, 6) as expected, round(variance, 6) as variance, round((moran - expected) / sqrt(variance), 6) as z from mi",
    "knn_edges": "with " + XY + ", " + e_sql(6) + "select run_id, src, dst, rank, round(dist, 6) as dist from e",
    "knn_edges_with_self": "with " + XY + ", " + e_sql(12, True) + "select run_id, src, dst, rank, round(dist, 6) as dist from e",
    "knn_embedding": """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v),
p as (select a.vec_id as src, b.vec_id as dst, round(greatest(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 0), 9) as d from u a join u b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select src, dst, row_number() over (partition by src order by d, dst) as rank, round(d, 6) as dist from p qualify rank <= 10""",
    "local_density": "with " + XY + ", " + e_sql(15, True) + """
, r as (select run_id, src, 1.0 / (avg(dist) + 1e-8) as raw from e group by all)
select run_id, src, round((raw - avg(raw) over (partition by run_id)) / stddev_pop(raw) over (partition by run_id), 6) as density from r""",
    "neighbour_majority": "with " + XY + ", " + LAB + ", " + e_sql(10, True) + VOTES + """
select run_id, src, label, votes, round(share, 6) as share from (select *, votes / (sum(votes) over (partition by run_id, src))::double as share, row_number() over (partition by run_id, src order by votes desc, label) as r from v) where r = 1""",
    "spatial_denoise": DENOISE,
    "local_shannon": "with " + XY + ", " + LAB + ", " + e_sql(50) + ENT + "select run_id, src, round(entropy, 6) as entropy from h",
    "diversity_hotspots": "with " + XY + ", " + LAB + ", " + e_sql(50) + ENT + ", q as (select run_id, quantile_cont(entropy, 0.95) as c from h group by 1) select run_id, src, round(entropy, 6) as entropy from h join q using (run_id) where round(entropy, 9) >= round(c, 9)",
    "moran_i": NORM + ", " + XY + ", " + e_sql(6) + MORAN + moran_sql("nrm", "x", "mi") + "select run_id, gene, round(moran, 6) as moran, round(expected, 6) as expected, round(variance, 6) as variance, round((moran - expected) / sqrt(variance), 6) as z from mi",
    "spatial_magnitude": NORM + ", " + XY + ", " + e_sql(6) + MORAN + moran_sql("nrm", "x", "mi") + f"""
, mz as (select run_id, gene, moran, (moran - expected) / sqrt(variance) as z from mi), mt as (select *, {tail_sql("z")} / 2 as t from mz),
mp as (select run_id, gene, moran, case when z > 0 then t else 1 - t end as p from mt),
mk as (select *, row_number() over (partition by run_id order by p, gene) as rn, count(*) over (partition by run_id) as k from mp),
mq as (select run_id, moran, (min(p * k / rn) over (partition by run_id order by rn desc rows unbounded preceding) < 0.05)::int as sig from mk)
select run_id, round(median(moran), 6) as median_moran, round(avg(moran), 6) as mean_moran, round(100 * avg(sig), 6) as pct_sig, round(0.6 * median(moran) + 0.4 * avg(sig), 6) as magnitude from mq group by 1""",
    "paired_genes": PAIRS + "select run_id, gene, round(lognorm, 6) as lognorm, round(raw, 6) as raw from pr",
    "paired_bootstrap": PAIRS + """
, rw as (select *, row_number() over (partition by run_id order by gene) - 1 as pos, count(*) over (partition by run_id) as n from pr),
sz as (select run_id, count(*) as n from pr group by 1),
dr as (select run_id, b, ('0x' || substr(md5('1_' || b || '_' || i), 1, 8))::bigint % n as pos from (select run_id, n, unnest(range(1, 1001)) as b from sz), lateral (select unnest(range(1, n + 1)) as i)),
bt as (select run_id, b, median(lognorm) as lognorm, median(raw) as raw from dr join rw using (run_id, pos) group by all),
bd as (select *, lognorm - raw as diff from bt)
select run_id, """ + ", ".join(f"round(quantile_cont({c}, {p}), 6) as {c}_{n}" for c in ("lognorm", "raw", "diff") for n, p in (("low", 0.025), ("high", 0.975))) + """,
  round(greatest(2 * least(avg((diff <= 0)::int), 1 - avg((diff <= 0)::int)), 1 / 1000), 6) as p from bd group by 1""",
    "paga_connectivity": "with " + XY + ", " + LAB + ", " + e_sql(6) + """
, t as (select e.run_id, a.cluster as src_cluster, b.cluster as dst_cluster, count(*) as n_edges from e join lab a on a.run_id = e.run_id and a.cell_id = e.src join lab b on b.run_id = e.run_id and b.cell_id = e.dst group by all)
select *, round(n_edges * (sum(n_edges) over (partition by run_id))::double / ((sum(n_edges) over (partition by run_id, src_cluster))::double * (sum(n_edges) over (partition by run_id, dst_cluster))::double), 6) as connectivity from t""",
    "unit_embeddings": """
with u as (select list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from u),
p as (select unnest(range(len(v))) as pos, unnest(v) / n as x from n)
select pos::int as pos, round(avg(x), 6) as mean, count(*) as n from p group by 1""",
}
