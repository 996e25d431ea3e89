"""Column roles found by candidate names, and the molecule table read through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted names of each role, in order of precedence.
ROLES = {
    "x": ("x", "x_location", "x_centroid", "x_pos", "x_um", "x_pixel"),
    "y": ("y", "y_location", "y_centroid", "y_pos", "y_um", "y_pixel"),
    "gene": ("gene", "feature_name", "gene_name", "target", "feature"),
}


def resolve(columns: list[str], role: str) -> str:
    """The first accepted name that is among ``columns``; ValueError if none is."""
    for name in ROLES[role]:
        if name in columns:
            return name
    raise ValueError(f"no column for {role}: one of {', '.join(ROLES[role])} is needed")


def read_molecules(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, gene, extra columns) of a Parquet molecule table; only these columns are read.

    Rows with a null or NaN coordinate or a null gene are dropped.
    """
    df = spark.read.parquet(path)
    names = {role: resolve(df.columns, role) for role in ROLES}
    t = df.select(F.col(names["x"]).cast("double").alias("x"), F.col(names["y"]).cast("double").alias("y"), F.col(names["gene"]).cast("string").alias("gene"), *extra)
    return t.na.drop(subset=["x", "y", "gene"])


def read_vectors(spark: SparkSession, path: str, id_: str) -> DataFrame:
    """(id_, v) of a CSV with one number column for each dimension; the header gives their order."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    dims = [c for c in df.columns if c != id_]
    return df.select(id_, F.array(*[F.col(f"`{c}`").cast("double") for c in dims]).alias("v"))
