"""Similarity features of segments, from rows (seg_id, i, seg_size, fp).

Each method gives rows (seg_id, fea_pos, fea), fea_pos from 0; a segment of at most F chunks is
its own feature list. Repeated features stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadup.config import RoutingConfig
from stratadup.functions.fingerprints import affine, is_boundary


def _short(members: DataFrame, count: int) -> DataFrame:
    return members.where(F.col("seg_size") <= count).select("seg_id", F.col("i").cast("long").alias("fea_pos"), F.col("fp").alias("fea"))


def finesse(members: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """The least fingerprint of each of F equal parts; the last part takes the remainder."""
    f = cfg.features
    long = members.where(F.col("seg_size") > f)
    part = F.least(F.expr(f"i div (seg_size div {f})"), F.lit(f - 1)).cast("long")
    return long.groupBy("seg_id", part.alias("fea_pos")).agg(F.min("fp").alias("fea")).unionByName(_short(members, f))


def mink(members: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """The F least fingerprints, repeats included, in (fp, i) order."""
    rank = F.row_number().over(Window.partitionBy("seg_id").orderBy("fp", "i")).cast("long") - 1
    long = members.where(F.col("seg_size") > cfg.features).withColumn("fea_pos", rank).where(F.col("fea_pos") < cfg.features)
    return long.select("seg_id", "fea_pos", F.col("fp").alias("fea")).unionByName(_short(members, cfg.features))


def first(members: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """The first fingerprint only."""
    return members.where("i = 0").select("seg_id", F.lit(0).cast("long").alias("fea_pos"), F.col("fp").alias("fea"))


def ntrans(members: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """For each of F affine hashes, the fingerprint with the greatest value, the first on a tie."""
    f = cfg.features
    long = members.where(F.col("seg_size") > f)
    best = [F.max_by("fp", F.struct(affine(F.col("fp"), j), -F.col("i"))).alias(f"f{j}") for j in range(f)]
    wide = long.groupBy("seg_id").agg(*best)
    out = wide.select("seg_id", F.posexplode(F.array(*[f"f{j}" for j in range(f)])).alias("fea_pos", "fea"))
    return out.withColumn("fea_pos", F.col("fea_pos").cast("long")).unionByName(_short(members, f))


def cdmink(members: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """The least fingerprint of each content-defined part; the F least of these if more.

    A boundary chunk begins a new part. Parts beyond the least segment size join the last one.
    """
    f = cfg.features
    long = members.where(F.col("seg_size") > f)
    mark = F.when((F.col("i") > 0) & is_boundary(F.col("fp"), max(cfg.segment // f, 1)), 1).otherwise(0)
    part = F.least(F.sum(mark).over(Window.partitionBy("seg_id").orderBy("i")), F.lit(cfg.least - 1)).cast("long")
    parts = long.withColumn("part", part).groupBy("seg_id", "part").agg(F.min("fp").alias("fea"))
    by_segment = Window.partitionBy("seg_id")
    parts = parts.withColumn("n", F.count("*").over(by_segment)).withColumn("r", F.row_number().over(by_segment.orderBy("fea", "part")).cast("long") - 1)
    kept = parts.where((F.col("n") <= f) | (F.col("r") < f))
    return kept.select("seg_id", F.when(F.col("n") <= f, F.col("part")).otherwise(F.col("r")).alias("fea_pos"), "fea").unionByName(_short(members, f))


METHODS = {"finesse": finesse, "mink": mink, "first": first, "ntrans": ntrans, "cdmink": cdmink}


def features(members: DataFrame, cfg: RoutingConfig) -> DataFrame:
    return METHODS[cfg.feature](members, cfg)
