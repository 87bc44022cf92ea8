"""Cutting lineage between iterations without relying on executor-local blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a scratch folder of its own; on a cluster a machine-local path
    would not survive the loss of that machine, so that case is refused.
    """
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


# Tables written within each open ``scratch`` block.
_OPEN: list[list[str]] = []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables cut inside the block when it ends; results must have been written elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove_folder(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there.

    The table is columnar and its size is known to later plans, the lineage is
    gone and the loss of an executor costs nothing that was written.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
