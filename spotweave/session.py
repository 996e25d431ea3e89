"""Session helpers: table access, checkpoints in the shared folder, size-checked choices."""

from __future__ import annotations

import functools
import importlib.util
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared checkpoint folder, and read back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session may do without it (tests on a laptop): a
    temporary folder is made for it. On a cluster such a folder would be another one on each machine, so its absence is an error. A written table survives lost executors, and unlike
    ``DataFrame.checkpoint`` it is read with its true size: there Catalyst's estimate, a product over all joins, is carried from
    round to round of an iteration until planning takes longer than the work.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spotweave-checkpoint-"))
        held = context._jsc.sc().getCheckpointDir()
    path = f"{held.get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df``, with the hint to broadcast it if it has at most ``most_rows`` rows; beyond that a join shuffles both sides. ``df`` should be a checkpoint."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores behind it until ``df`` has no such column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


@functools.lru_cache(maxsize=1)
def _archive(package: str) -> str:
    """A zip of the package, for the executors."""
    root = Path(importlib.util.find_spec(package).origin).parent
    stage = Path(tempfile.mkdtemp(prefix="spotweave-code-"))
    shutil.copytree(root, stage / "code" / package, ignore=shutil.ignore_patterns("__pycache__"))
    return shutil.make_archive(str(stage / package), "zip", stage / "code")


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after its code has been sent to the executors (once for each application)."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        path = _archive(__name__.partition(".")[0])
        if os.path.basename(path) not in {os.path.basename(f) for f in context._python_includes}:
            context.addPyFile(path)
        return query(spark, sf_dir)

    return run
