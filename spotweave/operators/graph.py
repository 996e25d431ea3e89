"""Connected components of an edge list, by alternating star operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.session import checkpoint


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 1000) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it is linked to.

    Large-star and small-star steps (Kiveris et al., SoCC 2014) halve distances to the smallest node, so chains of n nodes take
    about log n rounds; each is one grouping and one join of an edge list that never grows beyond the first. Lineage is cut by a
    reliable checkpoint each round, and the loop ends when a round changes nothing; RuntimeError if that takes more than ``rounds``. Loops and repeated edges are harmless, edges with a null
    end are ignored, and a node without an edge has no row. Nodes need a type with an order.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.filter("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components still change after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inside a task: the smallest node that each of n nodes is linked to by links (a, b)."""
    label = np.arange(n)
    while (open_ := label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])[open_]
        np.minimum.at(label, label[a][open_], low)
        np.minimum.at(label, label[b][open_], low)
        while (label[label] != label).any():
            label = label[label]
    return label
