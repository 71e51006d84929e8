"""Node lists: one `ip:port` per line, blanks allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Rows (node, ip, port) in line order; fails when there are fewer than `least`."""
    line = F.regexp_replace("value", r"\s", "")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn("value", line).where("value != ''")
    parsed = rows.select("line", F.regexp_extract("value", r"^(.+):(\d+)$", 1).alias("ip"), F.regexp_extract("value", r"^(.+):(\d+)$", 2).alias("port"))
    found = parsed.where("ip != ''")
    n = found.count()
    if n < least:
        raise ValueError(f"{path} lists {n} nodes, {least} are needed")
    from pyspark.sql import Window

    # a cluster's node list is short
    return found.select((F.row_number().over(Window.orderBy("line")) - 1).alias("node"), "ip", F.col("port").cast("int").alias("port"))
