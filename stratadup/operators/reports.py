"""Reports over decisions: per node, for the cluster, message volumes, prediction quality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadup.config import RoutingConfig
from stratadup.operators import nodes as nodes_of


def polled_rows(decisions: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (node, polls, replies) are implied by decisions: a poll asks every candidate once."""
    return decisions.agg(F.sum("polls").cast("long").alias("polls"), F.sum("replies").cast("long").alias("replies"))


def node_report(members: DataFrame, decisions: DataFrame, features: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Blocks, segments, features and segment traffic of every node, empty nodes included.

    A segment message has 12 bytes, 6 per feature slot and 6 per chunk; its reply has 16 and 6
    per duplicate. `members` may be the counts of `packs.counted`.
    """
    spark = members.sparkSession
    blocks = nodes_of.blocks(nodes_of.placed(members, decisions))
    segs = decisions.groupBy("node").agg(F.count("*").alias("fp_connec"))
    nodes = spark.range(cfg.nodes).select(F.col("id").cast("int").alias("node"))
    out = nodes.join(blocks, "node", "left").join(segs, "node", "left")
    if cfg.policy.startswith("stateless"):
        out = out.withColumn("fea_tab_size", F.lit(0).cast("long"))
    else:
        at = nodes_of.placed(features, decisions).select("node", "fea").distinct()
        out = out.join(at.groupBy("node").agg(F.count("*").alias("fea_tab_size")), "node", "left")
    out = out.na.fill(0)
    head = 12 + 6 * cfg.features
    return out.withColumns(
        {
            "segment_volume": F.col("fp_connec") * head + F.col("logic_block") * 6,
            "re_segment_volume": F.col("fp_connec") * 16 + (F.col("logic_block") - F.col("phy_block")) * 6,
        }
    ).select("node", "logic_block", "phy_block", "fea_tab_size", "fp_connec", "segment_volume", "re_segment_volume")


def cluster_report(nodes: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Totals over nodes, deduplication ratio, skew of physical blocks, and ratio over skew."""
    total = nodes.agg(*[F.sum(c).cast("long").alias(c) for c in ("logic_block", "phy_block", "fea_tab_size", "fp_connec", "segment_volume", "re_segment_volume")], F.max("phy_block").cast("long").alias("max_storage"))
    ratio = F.col("logic_block") / F.nullif(F.col("phy_block"), F.lit(0))
    skew = F.col("max_storage") * cfg.nodes / F.nullif(F.col("phy_block"), F.lit(0))
    mb = lambda c: F.expr(f"{c} div 1048576")
    return total.withColumns({"dedup_ratio": F.round(ratio, 6), "data_skew": F.round(skew, 6), "effective_ratio": F.round(ratio / skew, 6), "segment_mb": mb("segment_volume"), "re_segment_mb": mb("re_segment_volume")})


def route_volumes(decisions: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Polls and their traffic: 8 bytes and 6 per feature slot up, 16 down, and a container's 6
    per slot where one is attached."""
    return polled_rows(decisions, cfg).select(
        F.col("polls").alias("route_connec"),
        F.col("replies").alias("re_gp"),
        (F.col("polls") * (8 + 6 * cfg.features)).alias("route_volume"),
        (F.col("polls") * 16 + F.col("replies") * 6 * cfg.gp_size).alias("re_route_volume"),
        F.round(F.col("replies") * 100.0 / F.nullif(F.col("polls"), F.lit(0)), 6).alias("re_gp_rate"),
    )


def hit_statistics(decisions: DataFrame) -> DataFrame:
    """Decisions, hits and their mean by source, and how predicted hits spread over cached parts."""
    return decisions.groupBy("source").agg(
        F.count("*").alias("times"),
        F.sum("hit").cast("long").alias("hits"),
        F.round(F.avg("hit"), 6).alias("mean_hits"),
        F.sum("parts_hit").cast("long").alias("parts_hit"),
        F.round(F.sum("top_part") / F.nullif(F.sum("hit"), F.lit(0)), 6).alias("first_part_rate"),
        F.round(F.sum("second_part") / F.nullif(F.sum("hit"), F.lit(0)), 6).alias("second_part_rate"),
    )


def prediction_matrix(decisions: DataFrame) -> DataFrame:
    """Predictions against what a poll would have chosen; needs decisions with shadows.

    A prediction is right when the poll agrees; not predicting is right when the poll's target
    has no hits."""
    predicted = F.col("source").isin("predicted", "lru")
    same, hit = F.col("node") == F.col("shadow_node"), F.col("shadow_hit") > 0
    c = decisions.agg(
        F.count_if(predicted & same).alias("tp"), F.count_if(predicted & ~same).alias("fp"), F.count_if(~predicted & ~hit).alias("tn"), F.count_if(~predicted & hit).alias("fn")
    )
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "positive": ratio(tp + fp, tp + fp + tn + fn)})


def locality(features: DataFrame, index: DataFrame, decisions: DataFrame, window: int) -> DataFrame:
    """Container lookups that fall into one of the last `window` distinct containers of the node.

    Lookups run in (seg_id, fea_pos) order on each decision's node; a lookup of a container is
    near when fewer than `window` other containers were looked up since its last one."""
    at = features.join(decisions.select("seg_id", "node"), "seg_id").join(index.select("node", "fea", "container_id"), ["node", "fea"])
    ordered = at.select("node", "seg_id", "fea_pos", "container_id").repartition("node").sortWithinPartitions("node", "seg_id", "fea_pos")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole nodes, one after another; only the last containers are kept."""
        recent: list[int] = []
        node, lookups, near = None, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([lookups], pa.int64()), pa.array([near], pa.int64())], names=["node", "lookups", "near"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != node:
                    if lookups:
                        yield row()
                    recent, node, lookups, near = [], k, 0, 0
                lookups += 1
                if c in recent:
                    near += 1
                    recent.remove(c)
                recent.append(c)
                if len(recent) > window:
                    del recent[0]
        if lookups:
            yield row()

    return ordered.select(F.col("node").cast("int").alias("node"), "container_id").mapInArrow(fold, "node int, lookups long, near long")


def append_report(report: DataFrame, path: str) -> None:
    """Append a report as JSON lines."""
    report.write.mode("append").json(path)


def text_report(report: DataFrame) -> DataFrame:
    """One `name: value` line per column of a one-row report."""
    pairs = F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in report.columns])
    return report.select(F.explode(pairs).alias("line"))
