"""Indexes of storage nodes as relations, from features and decisions.

A node's indexes are functions of what was assigned to it, in order: fingerprints and features
count where they occur first, and containers are ranges of a feature's rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadup.config import RoutingConfig
from stratadup.durable import durable
from stratadup.operators.packs import PART_BYTES


def placed(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of segments with their node; rows that have one keep it.

    Decisions grow with the input, so they are not sent to the driver."""
    return rows if "node" in rows.columns else rows.join(decisions.select("seg_id", "node").hint("merge"), "seg_id")


def dedup(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chunks with their node and whether the node already had the fingerprint."""
    at = placed(members, decisions)
    rank = F.row_number().over(Window.partitionBy("node", "fp").orderBy("seg_id", "i"))
    return at.withColumn("dup", rank > 1)


def blocks(rows: DataFrame) -> DataFrame:
    """Chunks and distinct fingerprints of every node, from placed members or from `packs.counted`.

    Distinct fingerprints come first, then sums: the count per node needs no wide state. The rows
    per node are written once, so that no task sums more than a small part of the fingerprints."""
    times = F.sum("n") if "n" in rows.columns else F.count("*")
    per_fp = rows.groupBy("node", "fp").agg(times.alias("c"))
    return durable(per_fp.groupBy("node").agg(F.sum("c").alias("logic_block"), F.count("*").alias("phy_block")), part_bytes=PART_BYTES)


def feature_index(features: DataFrame, decisions: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (node, fea, rank, container_id, slot): each node's features in order of insertion."""
    at = placed(features, decisions)
    seen = at.groupBy("node", "fea").agg(F.min(F.struct("seg_id", "fea_pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("at.seg_id", "at.fea_pos")).cast("long")
    size = cfg.gp_size
    return seen.withColumn("rank", rank).select(
        "node", "fea", "rank", F.expr(f"(rank - 1) div {size}").alias("container_id"), F.expr(f"(rank - 1) % {size}").alias("slot")
    )


def similarity(features: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (seg_id, node, hits): features that an earlier segment brought to the node."""
    at = placed(features, decisions)
    index = at.groupBy("node", "fea").agg(F.min("seg_id").alias("first_seg"))
    probe = features.select("seg_id", "fea").join(index.hint("merge"), "fea").where("first_seg < seg_id")
    return probe.groupBy("seg_id", "node").agg(F.count("*").alias("hits"))


def best_container(features: DataFrame, index: DataFrame) -> DataFrame:
    """Per segment and node, the container with most matching features, the earliest on a tie."""
    found = features.select("seg_id", "fea_pos", "fea").join(index.select("node", "fea", "container_id").hint("merge"), "fea")
    counts = found.groupBy("seg_id", "node", "container_id").agg(F.count("*").alias("matches"), F.min("fea_pos").alias("first_pos"))
    best = F.max_by(F.struct("container_id", "matches"), F.struct("matches", -F.col("first_pos"), -F.col("container_id")))
    return counts.groupBy("seg_id", "node").agg(best.alias("b")).select("seg_id", "node", "b.container_id", "b.matches")


def first_segments(features: DataFrame) -> DataFrame:
    """Rows (fea, first_seg): the segment that brought a feature first."""
    return features.groupBy("fea").agg(F.min("seg_id").alias("first_seg"))


def hit_features(features: DataFrame, index: DataFrame) -> DataFrame:
    """Features that an earlier segment brought to the index (fea, first_seg)."""
    return features.join(index, "fea").where("first_seg < seg_id").drop("first_seg")


def unhit_features(features: DataFrame, index: DataFrame) -> DataFrame:
    """Features that no earlier segment brought to the index; only these need a probe."""
    known = index.select(F.col("fea").alias("_fea"), "first_seg")
    return features.join(known, (F.col("fea") == F.col("_fea")) & (F.col("first_seg") < F.col("seg_id")), "left_anti")
