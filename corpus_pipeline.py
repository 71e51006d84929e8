"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

quality rules -> line classifier -> near duplicates -> repeated passages -> packing. A stage is
a function of (spark, docs, sf_dir); all but the last return the columns of `documents`.

A row is a document: every decision is taken row by row, also where rows share an id or have
none. Null and empty texts fail the rules. Of near duplicates the row with the least id stays, of
equal ids one; null ids come last. An empty table stays empty. Columns that `documents` does not have are dropped, whatever their names. Stage outputs
but the last are deleted when the last is written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadup.llm import line_crf, ngram_join, packing, robust_rules, substring_dedup
from stratadup.llm.durable import durable, relieve, remove, shared_dir
from stratadup.llm.textkit import pick

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    relieve(spark)
    return robust_rules.accepted(docs, tuple(COLUMNS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    relieve(spark)
    model = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score(docs, model, keep=tuple(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each linked group stays."""
    relieve(spark)
    docs = pick(docs, *COLUMNS)
    again = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("again"))
    if not again.limit(1).count():
        ids = ngram_join.link(docs).where("doc_id = component_id").select("doc_id")
        return docs.join(ids, "doc_id", "left_semi").select(*COLUMNS)
    # rows are numbered in the order of their ids, null ones last
    numbered = docs.withColumn("read", F.monotonically_increasing_id()).orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"), "read")
    rows = durable(numbered.drop("read").withColumn("row", F.monotonically_increasing_id()))
    ids = ngram_join.link(rows.select(F.col("row").alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias("row"))
    return rows.join(ids, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; texts without any stay as they are, emptied ones leave."""
    relieve(spark)
    cut = substring_dedup.remove_repeats(docs, keep=tuple(COLUMNS))
    n_chars = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars")
    left = cut.where(F.col("kept").isNull() | (F.col("kept") != ""))
    return left.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source", n_chars)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all remaining documents."""
    relieve(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack_windows),
]

#: No SQL expresses the trained classifier or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline_{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        at = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
