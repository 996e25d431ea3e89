"""Factorisation, communities and the Bayesian models."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import bayes as b
from spotweave.operators import community as g
from spotweave.operators import factor as f
from spotweave.operators.clusters import spatial_posterior
from spotweave.operators.features import combined_features, standardised
from spotweave.operators.knn import knn_plane, knn_vectors, local_density
from spotweave.operators.markers import contrasts
from spotweave.operators.matrix import normalised, variable_genes
from spotweave.plans.base import RUN, centroids, counts, labels
from spotweave.session import checkpoint, table

CELL, GENE = "cell_id", "gene"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _edges(s, d, k):
    return knn_plane(centroids(s, d), RUN, CELL, "x", "y", k)


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def pca_scores(s, d):
    return f.vector_pca(_vectors(s, d), "vec_id", "v", 8)[0].select("vec_id", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


def pca_whitened(s, d):
    return f.vector_pca(_vectors(s, d), "vec_id", "v", 8, whiten=True)[0].select("vec_id", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


def _count_pca(s, d):
    n = counts(s, d)
    return f.count_pca(normalised(n, RUN, CELL), RUN, CELL, GENE, "x", variable_genes(n, RUN, CELL, GENE, 2000), 50)


def count_pca(s, d):
    return _count_pca(s, d).select(*RUN, CELL, F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


def count_elbow(s, d):
    """Elbow of each run's gene totals in descending order."""
    t = counts(s, d).groupBy(*RUN, GENE).agg(F.sum("n").cast("double").alias("n")).withColumn("o", F.struct(-F.col("n"), F.col(GENE)))
    return f.elbow(t, RUN, "o", "n")


def community_labels(s, d):
    return g.communities(_edges(s, d, 12), RUN)


def community_modularity(s, d):
    e = _edges(s, d, 12)
    return g.modularity(e, g.communities(e, RUN), RUN).select(*RUN, "n_communities", *r6("modularity"))


def label_modularity(s, d):
    return g.modularity(_edges(s, d, 12), labels(s, d).select(*RUN, F.col(CELL).alias("node"), F.col("cluster").alias("community")), RUN).select(*RUN, "n_communities", *r6("modularity"))


def _posterior(s, d):
    basis = b.spatial_basis(_edges(s, d, 15), RUN)
    return checkpoint(b.posteriors(b.gene_fits(normalised(counts(s, d), RUN, CELL), basis, RUN, CELL, GENE, "x"), RUN, GENE))


def bayes_gene_fit(s, d):
    return _posterior(s, d).select(*RUN, GENE, *r6("log_bf", "fsv", "sigma_s2", "sigma_e2", "pi", "posterior"))


def cluster_bayes_markers(s, d):
    """The whole ranking (rate 1); ``select_bfdr`` cuts it at any rate."""
    n = counts(s, d)
    return b.cluster_bayes_markers(_posterior(s, d), contrasts(n, labels(s, d), RUN, CELL, GENE, "n"), RUN, GENE, 1.0).select(*RUN, "cluster", "rank", GENE, *r6("posterior"))


def coupled_posterior(s, d):
    """Entropy and confidence of each cell's label in the space of posterior-weighted expression."""
    posterior = _posterior(s, d)
    weighted = b.weighted_features(b.scaled_features(normalised(counts(s, d), RUN, CELL), RUN, CELL, GENE, "x"), posterior, RUN, GENE)
    space = f.count_pca(weighted, RUN, CELL, GENE, "z", posterior, 50).join(labels(s, d), [*RUN, CELL])
    return spatial_posterior(space, _edges(s, d, 12), RUN, CELL, "cluster", "scores").select(*RUN, CELL, "label", "candidate", *r6("confidence", "entropy"))


def _space(s, d):
    """Principal components of each run's cells, standardised; 30 at most."""
    n = checkpoint(counts(s, d))
    return checkpoint(standardised(checkpoint(f.count_pca(normalised(n, RUN, CELL), RUN, CELL, GENE, "x", variable_genes(n, RUN, CELL, GENE, 2000), 30)), RUN, CELL, "scores"))


def latent_neighbours(s, d):
    """The 15 nearest cells of every cell in the space of principal components."""
    v = _space(s, d)
    return knn_vectors(v, v, CELL, "scores", 15, by=RUN).select(*RUN, "src", "dst", "rank", *r6("dist"))


def latent_density(s, d):
    """Local density in the space of principal components, self included."""
    v = _space(s, d)
    own = v.select(*RUN, F.col(CELL).alias("src"), F.col(CELL).alias("dst"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("dist"))
    return local_density(knn_vectors(v, v, CELL, "scores", 14, by=RUN).unionByName(own), RUN).select(*RUN, "src", *r6("density"))


def community_resolutions(s, d):
    """The sweep of resolutions on the cosine neighbour graph of each run: communities, silhouette, and the one to take."""
    v = _space(s, d)
    e = knn_vectors(v, v, CELL, "scores", 15, cosine=True, by=RUN)
    labels_ = g.communities(e, RUN, resolutions=[0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0])
    t = g.choose_resolution(labels_, v, RUN, CELL, "scores")
    return t.select(*RUN, "resolution", "n_communities", *r6("silhouette"), "chosen")


def spatial_domains(s, d):
    """Communities of each run's cells in the combined space of expression, soft labels, place and density, by 30 cosine neighbours at 1.25 times the resolution."""
    t = _space(s, d).join(centroids(s, d).select(*RUN, CELL, "x", "y"), [*RUN, CELL])
    v = checkpoint(combined_features(t, RUN, CELL, "scores", "x", "y", 15))
    e = knn_vectors(v, v, CELL, "features", 30, cosine=True, by=RUN)
    return g.communities(e, RUN, 1.25).withColumnRenamed("community", "domain")


QUERIES = {q.__name__: q for q in (pca_scores, pca_whitened, count_pca, count_elbow, community_labels, community_modularity, label_modularity, bayes_gene_fit, cluster_bayes_markers, coupled_posterior, latent_neighbours, latent_density, community_resolutions, spatial_domains)}


def _sql() -> dict[str, str]:
    from spotweave.plans.base import CNT, LAB, XY
    from spotweave.plans.spatial_queries import e_sql

    return {
        "count_elbow": CNT + """
, t as (select run_id, gene, sum(n)::double as v from cnt group by all),
i as (select *, row_number() over w as i, count(*) over (partition by run_id) as n, first(v) over (w rows between unbounded preceding and unbounded following) as a, last(v) over (w rows between unbounded preceding and unbounded following) as b from t window w as (partition by run_id order by v desc, gene)),
d as (select run_id, i, round(abs((b - a) * (i - 1) - (n - 1) * (v - a)) / sqrt((b - a) ** 2 + (n - 1) ** 2), 9) as d from i)
select run_id, greatest(least(arg_max(i, struct_pack(d := d, i := -i)), 50), 5)::int as elbow from d group by 1""",
        "label_modularity": "with " + XY + ", " + LAB + ", " + e_sql(12) + """
, u as (select run_id, src, dst from e union select run_id, dst, src from e),
t as (select u.run_id, a.cluster as a, b.cluster as b from u join lab a on a.run_id = u.run_id and a.cell_id = u.src join lab b on b.run_id = u.run_id and b.cell_id = u.dst),
m as (select run_id, count(*)::double as m2, avg((a = b)::int) as inside from t group by 1),
k as (select run_id, a, count(*)::double as k from t group by all), k2 as (select run_id, sum(k * k) as k2, count(*) as n_communities from k group by 1)
select run_id, n_communities, round(inside - k2 / (m2 * m2), 6) as modularity from m join k2 using (run_id)""",
    }


SQL = _sql()
