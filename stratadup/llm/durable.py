"""Cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from stratadup.durable import CLEANUP, cleaned, durable, shared_dir
from stratadup.llm.textkit import give_back

__all__ = ["CLEANUP", "Scratch", "durable", "mounted_dir", "relieve", "remove", "shared_dir"]


class Scratch:
    """Tables written to the shared folder as Parquet, for results that are large but short-lived.

    `clear` deletes them; frames that still read them are then of no use.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/scratch_{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        at = f"{self.base}/{uuid.uuid4().hex}"
        with cleaned(self.spark):
            df.write.parquet(at)
        return self.spark.read.parquet(at)

    def clear(self) -> None:
        remove(self.spark, self.base)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def relieve(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans, generated classes and handles of finished jobs, which
    also lets Spark clean up what they referred to. The freed memory goes back to the system."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.java.lang.System.gc()


def mounted_dir(spark: SparkSession) -> str:
    """The shared folder as a path that workers can open and map into memory."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise RuntimeError(f"memory-mapped models need a mounted shared folder, not {url.scheme}:")
    return url.path
