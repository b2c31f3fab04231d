"""Intermediate tables in the cluster's shared folder.

A few operators need a stage boundary: a frame whose rows must not be computed twice with
different partition numbers, or whose lineage must be cut. They write a Parquet table below the
folder named by ``spark.checkpoint.dir``, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors must share.

    Where it is unset, a single-process session (tests) gets a temporary folder; a cluster gets an
    error, because executors would not see each other's files.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="adjudica-"))
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/adjudica/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a reader of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # Read with the known schema: no inference job, and empty frames stay readable.
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables this process wrote; call when no frame over them is in use."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed
