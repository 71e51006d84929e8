"""Rows written once to the folder that the whole cluster shares, and read from there."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
PART_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key) if spark._jsparkSession.conf().contains(key) else None
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions begun inside delete their shuffle files when they end: what they wrote is what
    later steps read, and a lost executor's part of that lies in the shared folder."""
    with _set(spark, CLEANUP, "true"):
        yield


def durable(df: DataFrame, read_rows: int | None = None, part_bytes: int | None = None) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    `read_rows`: so many rows of a Parquet file are unpacked at a time; with long texts Spark's
    4,096 are arrays of 10 MB and more in every task, for which a small heap may have no room.
    `part_bytes`: shuffled partitions are put together up to so many bytes, where the session has
    not a smaller size; a task that sorts more than its part of the heap holds buffers of MBs for
    every spill, which Spark does not count."""
    spark = df.sparkSession
    shared_dir(spark)
    named = spark.conf.get(PART_BYTES)
    least = min(part_bytes or 1 << 62, spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named))
    with cleaned(spark), _set(spark, READ_ROWS, str(read_rows or spark.conf.get(READ_ROWS))), _set(spark, PART_BYTES, str(least)):
        return df.select("*").checkpoint()
