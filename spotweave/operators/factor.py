"""Principal components from a distributed Gram matrix, and choices made on their spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vector_pca(vectors: DataFrame, id_: str, v: str, k: int, whiten: bool = False) -> tuple[DataFrame, np.ndarray]:
    """((id_, scores array), explained variances): centred principal component scores of dense vectors.

    Each partition adds up n, sum and the Gram matrix of its vectors; the d x d sums (d columns, whatever the rows) meet on the driver, where
    the eigenproblem is solved. Signs are fixed so that each loading of largest absolute value is positive. ``whiten`` divides scores by the root
    of their variance. Null vectors are left out; k is cut to min(k, n - 1, d).
    """

    def gram(batches):
        total = None
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy()).astype(float)
                one = (len(m), m.sum(0), m.T @ m)
                total = one if total is None else tuple(x + y for x, y in zip(total, one))
        if total is not None:
            yield pd.DataFrame({"n": [total[0]], "s": [total[1].tolist()], "g": [total[2].ravel().tolist()]})

    rows = vectors.select(F.col(id_).alias("id"), F.col(v).cast("array<double>").alias("v")).filter("v is not null")
    sums = rows.select("v").mapInPandas(gram, "n long, s array<double>, g array<double>")
    # Partial sums of partitions are added position by position in the shuffle.
    flat = sums.select("n", F.posexplode(F.concat("s", "g")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not flat:
        return rows.limit(0).select(F.col("id").alias(id_), F.col("v").alias("scores")), np.zeros(0)
    n, d = flat[0]["n"], int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    x = np.array([r["x"] for r in flat])
    mean, g = x[:d] / n, x[d:].reshape(d, d)
    values, axes = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(n - 1, 1))
    k = max(1, min(k, n - 1, d))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    w = axes / np.sqrt(np.maximum(values, 1e-300)) if whiten else axes
    shared = vectors.sparkSession.sparkContext.broadcast((mean, w))
    kind = rows.schema["id"].dataType.simpleString()

    def project(batches):
        m, w = shared.value
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "scores": list((np.stack(b["v"].to_numpy()).astype(float) - m) @ w)})

    return rows.mapInPandas(project, f"id {kind}, scores array<double>").withColumnRenamed("id", id_), values


def count_pca(values: DataFrame, by: list[str], cell: str, gene: str, x: str, genes: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(by, cell, scores): principal components of sparse values over each dataset's chosen ``genes`` (by, gene), absent entries being zeros.

    Every cell of ``values`` has scores, also one without any chosen gene. A dataset of up to ``block`` cells is solved in one task. Of a larger one each
    block of cells gives its part of the Gram matrix (a dataset's genes are bounded by its panel), one task solves the sum, and the loadings come back
    to the blocks. Scores are centred. Signs: the loading of largest absolute value is positive.
    """
    from spotweave.session import checkpoint

    chosen = genes.select(*by, gene).distinct().withColumn("__use", F.lit(True))
    v = values.select(*by, cell, gene, F.col(x).cast("double").alias("x")).join(chosen, [*by, gene], "left").select(*by, F.col(cell).alias("cell"), F.when(F.col("__use"), F.col(gene)).alias("gene"), "x")
    sizes = checkpoint(values.groupBy(*by).agg(F.countDistinct(cell).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def dense(pdf: pd.DataFrame, names: np.ndarray | None = None):
        cells, i = np.unique(pdf["cell"].to_numpy(), return_inverse=True)
        given = pdf["gene"].notna().to_numpy() & pdf["x"].notna().to_numpy()
        g = pdf["gene"].to_numpy()[given].astype(str)
        names = np.unique(g) if names is None else names
        m = np.zeros((len(cells), len(names)))
        np.add.at(m, (i[given], np.searchsorted(names, g)), pdf["x"].to_numpy()[given])
        return cells, names, m

    def solve(n: int, total: np.ndarray, gram: np.ndarray):
        mean = total / n
        values, axes = np.linalg.eigh((gram - n * np.outer(mean, mean)) / max(n - 1, 1))
        keep = max(1, min(k, n - 1, len(total)))
        axes = axes[:, ::-1][:, :keep]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(keep)])
        return axes, mean @ axes

    def keyed(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, **columns})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, names, m = dense(pdf)
        if not len(names):
            return pd.DataFrame(columns=[*by, "cell", "scores"])
        w, c = solve(len(m), m.sum(0), m.T @ m)
        return keyed(pdf, cell=cells, scores=list(m @ w - c))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, names, m = dense(pdf)
        return keyed(pdf, n=[len(cells)], names=[names.tolist()], total=[m.sum(0).tobytes()], gram=[(m.T @ m).tobytes()])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([np.asarray(x, dtype=str) for x in pdf["names"]]))
        total, gram = np.zeros(len(names)), np.zeros((len(names), len(names)))
        if not len(names):
            return pd.DataFrame(columns=[*by, "names", "w", "c"])
        for own, t, g in zip(pdf["names"], pdf["total"], pdf["gram"]):
            i = np.searchsorted(names, np.asarray(own, dtype=str))
            total[i] += np.frombuffer(t)
            gram[np.ix_(i, i)] += np.frombuffer(g).reshape(len(i), len(i))
        w, c = solve(int(pdf["n"].sum()), total, gram)
        return keyed(pdf, names=[names.tolist()], w=[w.tobytes()], c=[c.tobytes()])

    def project(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*by, "cell", "scores"])
        r = right.iloc[0]
        c = np.frombuffer(r["c"])
        cells, _, m = dense(left, np.asarray(r["names"], dtype=str))
        return keyed(left, cell=cells, scores=list(m @ np.frombuffer(r["w"]).reshape(-1, len(c)) - c))

    schema = f"{keys}, cell {kinds['cell']}, scores array<double>"
    large = sizes.filter("blocks > 1")
    if large.isEmpty():
        return v.groupBy(*by).applyInPandas(whole, schema).withColumnRenamed("cell", cell)
    out = v.join(large.select(*by), by, "left_anti").groupBy(*by).applyInPandas(whole, schema)
    cut = v.join(large, by).withColumn("block", F.pmod(F.xxhash64("cell"), "blocks").cast("int")).select(*by, "block", "cell", "gene", "x")
    sums = cut.groupBy(*by, "block").applyInPandas(part, f"{keys}, n int, names array<string>, total binary, gram binary")
    loads = sums.groupBy(*by).applyInPandas(merge, f"{keys}, names array<string>, w binary, c binary")
    loads = loads.join(large.select(*by, "blocks"), by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    scores = cut.groupBy(*by, "block").cogroup(loads.groupBy(*by, "block")).applyInPandas(project, schema)
    return out.unionByName(scores).withColumnRenamed("cell", cell)


def elbow(values: DataFrame, by: list[str], order: str, value: str, least: int = 5, most: int = 50) -> DataFrame:
    """(by, elbow): 1-based place farthest from the chord between the first and last value, the first of equals, clamped."""
    w = Window.partitionBy(*by)
    v = F.col("__v")
    t = values.select(*by, F.col(order).alias("__o"), F.col(value).alias("__v"))
    t = t.withColumn("__i", F.row_number().over(w.orderBy("__o"))).withColumn("__n", F.count(F.lit(1)).over(w) - 1)
    ends = w.orderBy("__o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("__a", F.first("__v").over(ends)).withColumn("__d", F.last("__v").over(ends) - F.col("__a"))
    far = F.abs(F.col("__d") * (F.col("__i") - 1) - F.col("__n") * (v - F.col("__a"))) / F.sqrt(F.col("__d") * F.col("__d") + F.col("__n") * F.col("__n"))
    t = t.withColumn("__far", F.round(far, 9))
    return t.groupBy(*by).agg(F.greatest(F.least(F.max_by("__i", F.struct("__far", -F.col("__i"))), F.lit(most)), F.lit(least)).alias("elbow"))
