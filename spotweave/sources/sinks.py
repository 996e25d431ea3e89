"""Writers of the engine's results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators.matrix import triplets, wide_matrix


def write_wide_csv(counts: DataFrame, by: list[str], cell: str, gene: str, genes: list[str], path: str, gzip: bool = True) -> None:
    """Dense cell-by-gene CSV, zeros filled in, one file for each partition."""
    wide_matrix(counts, by, cell, gene, genes).write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_matrix_market(counts: DataFrame, cell: str, gene: str, path: str) -> None:
    """Coordinate matrix (genes x cells), barcodes and features under ``path``: parts in range order, so that they concatenate to one sorted file."""
    t = triplets(counts, cell, gene)
    size = t.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count(F.lit(1)).alias("n"))
    head = size.select(F.concat_ws("\n", F.lit("%%MatrixMarket matrix coordinate integer general"), F.concat_ws(" ", *[F.coalesce(k, F.lit(0)).cast("string") for k in ("r", "c", "n")])).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/header")
    t.repartitionByRange("col", "row").sortWithinPartitions("col", "row").select(F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("value").cast("string")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{path}/matrix")
    names = counts.select(F.col(cell).alias("value")).distinct()
    names.repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").option("compression", "gzip").text(f"{path}/barcodes")
    rows = counts.select(gene).distinct().repartitionByRange(gene).sortWithinPartitions(gene)
    rows.select(F.concat_ws("\t", gene, gene, F.lit("Gene Expression")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{path}/features")


def write_bundle(counts: DataFrame, cells: DataFrame, cell: str, gene: str, path: str, embeddings: dict[str, tuple[DataFrame, str, str]] | None = None) -> None:
    """The coordinate matrix with ``metadata`` (``cells`` as it is) and one CSV for each embedding: name -> (rows of (cell, vector), vector column, column prefix).

    A vector becomes columns prefix1, prefix2, ..; all vectors of an embedding have the length of its longest, missing components are empty.
    """
    write_matrix_market(counts, cell, gene, path)
    cells.write.mode("overwrite").option("header", True).csv(f"{path}/metadata")
    for name, (rows, v, prefix) in (embeddings or {}).items():
        wide = rows.select(F.max(F.size(v))).first()[0] or 0
        rows.select(cell, *[F.get(v, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(wide)]).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A set of tables as Parquet, each under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_csv_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Cluster tables, posterior tables and the like as CSV with a header, each under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_assignment_record(mappings: DataFrame, by: list[str], path: str) -> None:
    """One JSON object for each dataset: the mapping that ``score_mappings`` found best and what it assigns."""
    write_json_record(mappings.filter("best").select(*by, "mapping", "n_valid", "n_assigned", "n_cells"), path)


def write_json_record(df: DataFrame, path: str) -> None:
    """Each row as one JSON object, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_snapshot(tables: dict[str, DataFrame], path: str, stage: str) -> None:
    """Several tables as CSV under names that end in the stage."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}_{stage}")
