"""Spatially structured genes: graph-spectral evidence, empirical-Bayes posteriors, cluster markers and their coupling back to cells.

A dataset's neighbour graph gives a low-rank basis (the smoothest eigenvectors of its Laplacian). Each gene's variance is split into a part
along the basis and noise by maximum likelihood, profiled to one dimension; the evidence is a BIC difference; a common prior follows by fixed point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.session import checkpoint

#: Clamps of the prior and eigenvalues counted as zero.
PRIOR_FLOOR, ZERO_EIGENVALUE = 1e-4, 1e-8


def symmetric_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """The union of the edges and their reverses, each once, without loops."""
    e = edges.select(*by, "src", "dst").filter("src <> dst")
    return e.unionByName(e.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def spatial_basis(edges: DataFrame, by: list[str], m: int = 100, normalise: bool = True, dense: int = 3000) -> DataFrame:
    """(by, cell, u, gamma): per cell its entries of the ``m`` smoothest non-constant Laplacian eigenvectors, and their eigenvalues, over all cells.

    A dataset of at most ``dense`` cells (or few for ``m``) is solved by dense eigenvectors in one task, a larger one by ``iterated_basis``. Both give the same vectors.
    """
    e = checkpoint(symmetric_edges(edges, by))
    large = e.groupBy(*by).agg(F.countDistinct("src").alias("n")).filter(F.col("n") > max(dense, 4 * m + 64)).select(*by)
    large = checkpoint(large)
    kinds = {f.name: f.dataType.simpleString() for f in e.schema}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        i, j = np.searchsorted(names, pdf["src"]), np.searchsorted(names, pdf["dst"])
        a = np.zeros((len(names), len(names)))
        a[i, j] = 1.0
        degree = a.sum(1)
        if normalise:
            s = 1 / np.sqrt(np.maximum(degree, 1e-12))
            lap = np.eye(len(names)) - s[:, None] * a * s[None]
        else:
            lap = np.diag(degree) - a
        gamma, u = np.linalg.eigh(lap)
        use = np.flatnonzero(gamma > ZERO_EIGENVALUE)[:m]
        u, gamma = u[:, use], gamma[use]
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(use))] < 0, -1.0, 1.0) if len(use) else u
        out = pd.DataFrame({"cell": names, "u": list(u), "gamma": [gamma] * len(names)})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "cell", "u", "gamma"]]

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    schema = f"{keys}, cell {kinds['src']}, u array<double>, gamma array<double>"
    if large.isEmpty():
        return e.groupBy(*by).applyInPandas(solve, schema)
    small = e.join(large, by, "left_anti").groupBy(*by).applyInPandas(solve, schema)
    return small.unionByName(iterated_basis(e.join(large, by, "left_semi"), by, m, normalise))


def iterated_basis(e: DataFrame, by: list[str], m: int, normalise: bool = True, tolerance: float = 1e-7, rounds: int = 60, block: int = 8192, width: int = 8) -> DataFrame:
    """The columns of ``spatial_basis`` for large datasets, by subspace iteration with a Chebyshev filter; ``e`` holds symmetric edges.

    Cells are numbered and lie in blocks. In each round a task filters ``width`` of the 1.25 * ``m`` vectors, holding the dataset's neighbour lists (4 bytes an edge) and
    those columns only; then each block of cells adds its part to the Gram matrices, the small problem they form is solved once for a dataset, and
    the blocks are turned to its solution. The null space is known (constant on connected parts) and taken out of every vector. A round's
    result is checkpointed; a dataset is done when all residuals are below ``tolerance`` times the last eigenvalue. It fails if that takes over ``rounds``.
    """
    from spotweave.operators.skew import number_rows

    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    groups = -(-5 * m // (4 * width))
    p = groups * width
    cells = checkpoint(number_rows(e.select(*by, F.col("src").alias("cell")).distinct(), by, ["cell"], "i").select(*by, "cell", (F.col("i") - 1).cast("long").alias("i")))
    a, b = (cells.select(*by, F.col("cell").alias(k), F.col("i").alias(f"{k}_i")) for k in ("src", "dst"))
    pairs = e.join(a, [*by, "src"]).join(b, [*by, "dst"]).select(*by, F.floor(F.col("src_i") / block).cast("int").alias("block"), "src_i", "dst_i")

    def keyed(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, **columns})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src_i", "dst_i"])
        at = int(pdf["block"].iloc[0])
        degree = np.bincount(pdf["src_i"] - at * block).astype(np.int32)
        return keyed(pdf, block=[at], n=[len(degree)], degree=[degree.tobytes()], near=[pdf["dst_i"].to_numpy(dtype=np.int32).tobytes()])

    graph = checkpoint(pairs.groupBy(*by, "block").applyInPandas(pack, f"{keys}, block int, n int, degree binary, near binary"))
    every = graph.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def begin(batches):
        for x in batches:
            yield x[[*by, "g", "block"]].assign(u=[np.random.default_rng([g, k]).standard_normal((n, width)).tobytes() for g, k, n in zip(x["g"], x["block"], x["n"])], cut=-1.0)

    def smooth(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):  # the dataset is done
            return pd.DataFrame(columns=[*by, "g", "block", "u", "lu"])
        left, right = left.sort_values("block"), right.sort_values("block")
        count, near = (np.concatenate([np.frombuffer(x, dtype=np.int32) for x in right[c]]) for c in ("degree", "near"))
        n, first = len(count), np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        degree = count.astype(float)[:, None]
        s = 1 / np.sqrt(degree) if normalise else np.ones((n, 1))

        def lap(u: np.ndarray) -> np.ndarray:
            v, out = s * u, np.empty_like(u)
            for i in range(0, n, block):
                k = min(i + block, n)
                out[i:k] = np.add.reduceat(v[near[first[i] : first[k]]], first[i:k] - first[i], axis=0)
            return u - s * out if normalise else degree * u - out

        part, before = np.arange(n), None
        while before is None or (part != before).any():
            before = part
            part = np.minimum(part, np.minimum.reduceat(part[near], first[:-1]))
            part = part[part]
        part = np.unique(part, return_inverse=True)[1]
        flat = np.sqrt(degree[:, 0]) if normalise else np.ones(n)
        size = np.bincount(part, flat * flat)

        def centred(u: np.ndarray) -> np.ndarray:
            return np.column_stack([c - flat * (np.bincount(part, flat * c) / size)[part] for c in u.T])

        u = centred(np.concatenate([np.frombuffer(x).reshape(-1, width) for x in left["u"]]))
        high = 2.0 if normalise else 2 * float(degree.max())
        cut = float(left["cut"].iloc[0])
        cut = high / 4 if cut < 0 else min(cut, high / 2)
        middle, half = (high + cut) / 2, (high - cut) / 2
        old, u = u, (lap(u) - middle * u) / half
        for _ in range(int(np.ceil(5 * np.sqrt(high / cut))) - 1):
            old, u = u, 2 * (lap(u) - middle * u) / half - old
        u = centred(u)
        lu, ends = lap(u), np.cumsum(right["n"])
        return left[[*by, "g", "block"]].assign(u=[u[z - n : z].tobytes() for z, n in zip(ends, right["n"])], lu=[lu[z - n : z].tobytes() for z, n in zip(ends, right["n"])])

    def wide(pdf: pd.DataFrame, c: str) -> np.ndarray:
        return np.hstack([np.frombuffer(x).reshape(-1, width) for x in pdf.sort_values("g")[c]])

    def grams(pdf: pd.DataFrame) -> pd.DataFrame:
        u, lu = wide(pdf, "u"), wide(pdf, "lu")
        return keyed(pdf, gram=[np.stack([u.T @ u, u.T @ lu]).tobytes()])

    def ritz(pdf: pd.DataFrame) -> pd.DataFrame:
        g = sum(np.frombuffer(x) for x in pdf["gram"]).reshape(2, p, p)
        d = 1 / np.sqrt(np.maximum(np.diag(g[0]), 1e-300))
        w, q = np.linalg.eigh(d[:, None] * g[0] * d)
        keep = w > 1e-12 * w[-1]
        q = d[:, None] * q[:, keep] / np.sqrt(w[keep])
        theta, y = np.linalg.eigh(q.T @ (g[1] + g[1].T) / 2 @ q)
        turn = np.zeros((p, p))  # a vector that was lost starts anew
        turn[:, : len(theta)] = q @ y
        return keyed(pdf, theta=[np.concatenate([theta, np.full(p - len(theta), theta[-1])])], turn=[turn.tobytes()], kept=[len(theta)])

    def rotate(pdf: pd.DataFrame) -> pd.DataFrame:
        turn, theta, kept, at = np.frombuffer(pdf["turn"].iloc[0]).reshape(p, p), np.asarray(pdf["theta"].iloc[0]), int(pdf["kept"].iloc[0]), int(pdf["block"].iloc[0])
        u = wide(pdf, "u") @ turn
        rest = ((wide(pdf, "lu") @ turn - u * theta) ** 2).sum(0)
        rest[kept:] = np.inf
        u[:, kept:] = np.random.default_rng([kept, at, 1]).standard_normal((len(u), p - kept))
        cut = [slice(g * width, (g + 1) * width) for g in range(groups)]
        return keyed(pdf, g=range(groups), block=at, u=[np.ascontiguousarray(u[:, c]).tobytes() for c in cut], rest=[rest[c] for c in cut])

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        u = wide(pdf, "u")[:, :m]
        return keyed(pdf, i=np.arange(len(u)) + int(pdf["block"].iloc[0]) * block, u=list(u))

    state, done = every.mapInPandas(begin, f"{keys}, g int, block int, u binary, cut double"), []
    for _ in range(rounds):
        f = checkpoint(state.groupBy(*by, "g").cogroup(every.select(*by, "g", "block", "n", "degree", "near").groupBy(*by, "g")).applyInPandas(smooth, f"{keys}, g int, block int, u binary, lu binary"))
        gram = f.groupBy(*by, "block").applyInPandas(grams, f"{keys}, gram binary")
        solved = checkpoint(gram.groupBy(*by).applyInPandas(ritz, f"{keys}, theta array<double>, turn binary, kept int"))
        new = checkpoint(f.join(solved, by).groupBy(*by, "block").applyInPandas(rotate, f"{keys}, g int, block int, u binary, rest array<double>"))
        worst = new.select(*by, "g", F.posexplode("rest").alias("k", "r")).filter(F.col("g") * width + F.col("k") < m).groupBy(*by, "g", "k").agg(F.sqrt(F.sum("r")).alias("r")).groupBy(*by).agg(F.max("r").alias("r"))
        state = solved.join(worst, by).select(*by, F.slice("theta", 1, m).alias("gamma"), F.element_at("theta", p).alias("cut"), (F.col("r") <= tolerance * F.element_at("theta", m)).alias("done"))
        state = checkpoint(new.drop("rest").join(state, by))
        done.append(state.filter("done").select(*by, "g", "block", "u", "gamma"))
        state = state.filter("not done").select(*by, "g", "block", "u", "cut")
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"the basis has not converged after {rounds} rounds")
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    u = found.groupBy(*by, "block").applyInPandas(rows, f"{keys}, i long, u array<double>")
    sign = u.select(*by, "i", F.posexplode("u").alias("k", "x")).groupBy(*by, "k").agg(F.max(F.struct(F.abs("x"), -F.col("i"), F.signum("x").alias("s"))).alias("t"))
    sign = sign.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", F.col("t.s").alias("s")))).alias("s"))
    gamma = found.filter("g = 0 and block = 0").select(*by, "gamma")
    u = u.join(cells, [*by, "i"]).join(gamma, by).join(sign, by)
    return u.select(*by, "cell", F.zip_with("u", "s", lambda x, t: x * t["s"]).alias("u"), "gamma")


def profile_fits(n: int, s: np.ndarray, ss: np.ndarray, p: np.ndarray, us: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """(genes with variance, their log_bf, fsv, sigma_s2, sigma_e2) from sums, sums of squares and projections (genes x vectors) over ``n`` cells."""
    mean = s / n
    var = (ss - n * mean * mean) / max(n - 1, 1)
    use = np.flatnonzero(var > 1e-12)
    y2 = (p[use] - mean[use, None] * us) ** 2 / var[use, None]
    total = float(n - 1)
    rest = np.maximum(total - y2.sum(1), 1e-10)

    def cost(log_r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.exp(log_r)[:, None] / gamma + 1
        e2 = np.maximum(((y2 / c).sum(1) + rest) / n, 1e-10)
        return 0.5 * (n + np.log(c).sum(1) + n * np.log(e2) + n * np.log(2 * np.pi)), e2

    grid = np.linspace(-14, 14, 60)
    at = np.argmin([cost(np.full(len(use), g))[0] for g in grid], axis=0)
    low, high = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, len(grid) - 1)]
    step = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - step * (high - low), low + step * (high - low)
        left = cost(a)[0] <= cost(b)[0]
        low, high = np.where(left, low, a), np.where(left, b, high)
    best, e2 = cost((low + high) / 2)
    ratio = np.exp((low + high) / 2)
    null = 0.5 * (n + n * np.log(max(total / n, 1e-10)) + n * np.log(2 * np.pi))
    return use, pd.DataFrame({"log_bf": null - best - 0.5 * np.log(n), "fsv": ratio / (1 + ratio), "sigma_s2": ratio * e2, "sigma_e2": e2})


def gene_fits(values: DataFrame, basis: DataFrame, by: list[str], cell: str, gene: str, x: str, block: int = 4096) -> DataFrame:
    """(by, gene, log_bf, fsv, sigma_s2, sigma_e2): evidence of a spatial part of each gene's standardised values.

    A dataset's cells are cut into blocks of about ``block``; a block meets its part of the basis in one task and gives each gene's sums and projections
    on the basis, which are added up. From these the profile likelihood in the variance ratio is minimised on a grid and by golden section;
    a dataset of one block is fitted where it is summed. Genes without variance among the basis cells are left out.
    """
    v = values.select(*by, F.col(cell).alias("cell"), F.col(gene).alias("gene"), F.col(x).cast("double").alias("x"))
    sizes = checkpoint(values.groupBy(*by).agg(F.ceil(F.countDistinct(cell) / block).cast("int").alias("blocks")))
    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    # Both sides of the cogroup carry the number of blocks, each as a column of its own.
    blocked = lambda df: df.join(sizes, by).withColumn("blocks", F.col("blocks") + 0).withColumn("block", F.pmod(F.xxhash64("cell"), "blocks").cast("int"))
    names = ["log_bf", "fsv", "sigma_s2", "sigma_e2"]

    def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame(columns=[*by, "n", "genes", "s", "ss", "p", "us", "gamma", *names])
        u, gamma, n = np.stack(right["u"].to_numpy()), np.asarray(right["gamma"].iloc[0], dtype=float), len(right)
        i = pd.Index(right["cell"]).get_indexer(left["cell"])
        genes, j = np.unique(left["gene"].to_numpy(dtype=str)[i >= 0], return_inverse=True)
        m = np.zeros((n, len(genes)))
        np.add.at(m, (i[i >= 0], j), left["x"].to_numpy()[i >= 0])
        s, ss, p, us = m.sum(0), (m * m).sum(0), m.T @ u, u.sum(0)
        key = {c: right[c].iloc[0] for c in by}
        if right["blocks"].iloc[0] == 1:
            use, fit = profile_fits(n, s, ss, p, us, gamma)
            return pd.DataFrame({**key, "n": None, "genes": [genes[use].tolist()], "s": None, "ss": None, "p": None, "us": None, "gamma": None, **{c: [fit[c].tolist()] for c in names}})
        return pd.DataFrame({**key, "n": n, "genes": [genes.tolist()], "s": [s.tolist()], "ss": [ss.tolist()], "p": [p.tobytes()], "us": [us.tolist()], "gamma": [gamma.tolist()], **dict.fromkeys(names)})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        genes = np.unique(np.concatenate([np.asarray(g, dtype=str) for g in pdf["genes"]]))
        gamma = np.asarray(pdf["gamma"].iloc[0], dtype=float)
        s, ss, p = np.zeros(len(genes)), np.zeros(len(genes)), np.zeros((len(genes), len(gamma)))
        for r in pdf.itertuples(index=False):
            i = np.searchsorted(genes, np.asarray(r.genes, dtype=str))
            s[i] += r.s
            ss[i] += r.ss
            p[i] += np.frombuffer(r.p).reshape(len(i), -1)
        use, fit = profile_fits(int(pdf["n"].sum()), s, ss, p, np.stack(pdf["us"].to_numpy()).sum(0), gamma)
        return fit.assign(**{c: pdf[c].iloc[0] for c in by}, **{gene: genes[use]})[[*by, gene, *names]]

    part = blocked(v).groupBy(*by, "block").cogroup(blocked(basis.select(*by, "cell", "u", "gamma")).groupBy(*by, "block"))
    floats = lambda *c: ", ".join(f"{x} array<double>" for x in c)
    part = checkpoint(part.applyInPandas(add, f"{keys}, n int, genes array<string>, {floats('s', 'ss')}, p binary, {floats('us', 'gamma', *names)}"))
    one = part.filter("n is null").select(*by, F.explode(F.arrays_zip(F.col("genes").alias(gene), *names)).alias("t")).select(*by, f"t.{gene}", *[f"t.{c}" for c in names])
    more = part.filter("n is not null").groupBy(*by).applyInPandas(fold, f"{keys}, {gene} string, " + ", ".join(f"{c} double" for c in names))
    return one.unionByName(more)


def posteriors(fits: DataFrame, by: list[str], gene: str, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """fits with ``pi`` and ``posterior``: the prior share of spatial genes of each dataset by fixed point, and each gene's posterior under it.

    One iteration is the mean of sigmoid(log_bf + logit(pi)) over a dataset's genes, one number for each gene, in one aggregation.
    """
    kinds = {f.name: f.dataType.simpleString() for f in fits.schema}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        bf, pi = pdf["log_bf"].to_numpy(dtype=float), 0.5
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(bf + np.log(pi / (1 - pi)), -700, 700)))
            new = float(np.clip(p.mean(), PRIOR_FLOOR, 1 - PRIOR_FLOOR))
            done, pi = abs(new - pi) < tolerance, new
            if done:
                break
        p = 1 / (1 + np.exp(-np.clip(bf + np.log(pi / (1 - pi)), -700, 700)))
        return pdf.assign(pi=pi, posterior=p)

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", pi double, posterior double"
    return fits.groupBy(*by).applyInPandas(solve, schema)


def cluster_bayes_markers(posterior: DataFrame, contrast: DataFrame, by: list[str], gene: str, alpha: float = 0.05) -> DataFrame:
    """(by, cluster, rank, gene, posterior): spatial genes under the Bayesian false discovery rate that are raised in the cluster, by posterior."""
    from spotweave.operators.markers import best_per_group, select_bfdr

    chosen = select_bfdr(posterior, by, "posterior", gene, alpha).select(*by, gene, "posterior")
    raised = contrast.filter("contrast > 0").join(chosen, [*by, gene])
    return best_per_group(raised, [*by, "cluster"], F.col("posterior"), gene, 2**31 - 1).select(*by, "cluster", "rank", gene, "posterior")


def scaled_features(values: DataFrame, by: list[str], cell: str, gene: str, x: str) -> DataFrame:
    """values with ``z`` = x over the gene's deviation among all cells of the dataset (a deviation of 0 counts as 1), so that absent entries stay 0.

    These are the standardised values but for the mean, which a centred analysis takes out.
    """
    from spotweave.operators.matrix import gene_moments

    n = F.col("n_cells")
    sd = F.sqrt(F.greatest(F.col("variance") * (n - 1) / n, F.lit(0.0)))
    m = gene_moments(values, by, cell, gene, x).select(*by, gene, F.when(sd > 1e-12, sd).otherwise(1.0).alias("__sd"))
    return values.join(m, [*by, gene]).withColumn("z", F.col(x) / F.col("__sd")).drop("__sd")


def weighted_features(z: DataFrame, posterior: DataFrame, by: list[str], gene: str) -> DataFrame:
    """Values of ``scaled_features`` weighted by the root of the gene's posterior, clipped to [0, 1]."""
    weight = F.sqrt(F.greatest(F.least("posterior", F.lit(1.0)), F.lit(0.0)))
    return z.join(posterior.select(*by, gene, "posterior"), [*by, gene], "left").withColumn("z", F.col("z") * F.coalesce(weight, F.lit(0.0))).drop("posterior")
