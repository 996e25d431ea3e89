"""The count matrix kept up to date while molecule files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.keys import name_key


def latest_stream(molecules: DataFrame, delay: str = "2 days") -> DataFrame:
    """Molecule deliveries without repeats: each (transcript_id, loaded_at) once; repeats later than ``delay`` behind the watermark are dropped as late."""
    return molecules.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["transcript_id", "loaded_at"])


def stream_counts(molecules: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(window_start, run_id, cell_id, gene, n): deliveries of each gene in each cell by load window; state of closed windows is dropped."""
    t = latest_stream(molecules, delay).withColumn("gene", name_key("feature_name")).filter("gene is not null and cell_id is not null")
    t = t.groupBy(F.window("loaded_at", window).alias("w"), "run_id", "cell_id", "gene").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.col("w.start").alias("window_start"), "run_id", "cell_id", "gene", "n")
