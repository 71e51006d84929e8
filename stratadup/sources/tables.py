"""Tables as chunk streams: rows (trace, file_no, chunk_no, fp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadup.functions.fingerprints import of_text

BLOCK = 64


def blocks(df: DataFrame, trace: Column, file_no: Column, text: Column, size: int = BLOCK) -> DataFrame:
    """Fixed blocks of `size` characters, cut in one pass over a text; empty texts give files
    without chunks, which vanish."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = df.select(trace.alias("trace"), file_no.cast("long").alias("file_no"), F.posexplode(parts).alias("chunk_no", "part"))
    return rows.select("trace", "file_no", F.col("chunk_no").cast("long").alias("chunk_no"), of_text(F.col("part")).alias("fp"))


def pieces(df: DataFrame, trace: Column, file_no: Column, text: Column, separator: str) -> DataFrame:
    """Parts between separators as chunks, empty ones too."""
    out = df.where(F.length(text) > 0).select(trace.alias("trace"), file_no.cast("long").alias("file_no"), F.posexplode(F.split(text, separator, -1)).alias("chunk_no", "piece"))
    return out.select("trace", "file_no", F.col("chunk_no").cast("long").alias("chunk_no"), of_text(F.col("piece")).alias("fp"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return blocks(df, F.col("source"), F.col("doc_id"), F.col("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pieces(df, F.col("source"), F.col("doc_id"), F.col("text"), "\n")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return blocks(df, F.lit("pages"), F.col("page_id"), F.col("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return df.select(F.col("role").alias("trace"), F.col("conv_id").alias("file_no"), F.col("turn").alias("chunk_no"), of_text(F.col("text")).alias("fp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props")
    return df.select(F.col("event_type").alias("trace"), F.col("event_id").alias("file_no"), F.lit(0).cast("long").alias("chunk_no"), of_text(row).alias("fp"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag", "l_linestatus")
    return df.select(F.lit("lineitem").alias("trace"), F.col("l_orderkey").alias("file_no"), (F.col("l_linenumber") - 1).cast("long").alias("chunk_no"), of_text(row).alias("fp"))


def backups(chunks: DataFrame, n: int = 2) -> DataFrame:
    """The same traces n times over, all of one backup before the next."""
    times = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = chunks.withColumn("backup", times)
    return out.withColumn("trace", F.concat(F.lpad(F.col("backup").cast("string"), 4, "0"), F.lit("/"), "trace")).drop("backup")
