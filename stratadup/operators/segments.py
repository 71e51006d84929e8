"""Content-defined segments of ordered chunk streams.

Input: chunks (trace, file_no, chunk_no, fp). A segment ends at a boundary chunk once it has
the least size, or at the greatest size; it may cross files but never traces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadup.config import RoutingConfig
from stratadup.functions.fingerprints import is_boundary


def with_positions(chunks: DataFrame) -> DataFrame:
    """Add `pos`, from 1, in (file_no, chunk_no, fp) order within each trace.

    Chunks are numbered inside their file; only one row per file goes through the trace's
    ordered window. A null trace is the one with the empty name; a null file comes first.
    """
    chunks = chunks.withColumn("trace", F.coalesce("trace", F.lit("")))
    files = chunks.groupBy("trace", "file_no").agg(F.count("*").alias("n"))
    order = Window.partitionBy("trace").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("trace").alias("_trace"), F.col("file_no").alias("_file"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("trace", "file_no").orderBy("chunk_no", "fp"))
    joined = chunks.withColumn("k", inside).join(starts, (F.col("trace") == F.col("_trace")) & F.col("file_no").eqNullSafe(F.col("_file")))
    return joined.withColumn("pos", F.col("start") + F.col("k")).drop("start", "k", "_trace", "_file")


def cut_ends(marks: np.ndarray, n: int, near: int, far: int) -> np.ndarray:
    """Last positions of the segments of a trace of `n` chunks, from its boundary positions in order."""
    ends, start = [], 1
    for mark in marks.tolist():
        forced = (mark - start + 1) // far
        if forced > 0:
            ends.extend(range(start + far - 1, start + forced * far, far))
            start += forced * far
        if mark - start + 1 >= near:
            ends.append(mark)
            start = mark + 1
    ends.extend(range(start + far - 1, n + 1, far))
    if n and (not ends or ends[-1] < n):
        ends.append(n)
    return np.array(ends, np.int64)


def cuts(chunks: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (trace, seg, st, en): segments by position, both ends included, seg from 1.

    Only boundary positions are collected, about one chunk in `least`; a fold over them, in time
    proportional to their number, places the forced cuts in between.
    """
    near, far = cfg.least, cfg.most
    per_trace = chunks.groupBy("trace").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(is_boundary(F.col("fp"), near), F.col("pos")))).alias("marks"),
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trace, n, marks in zip(*(batch.column(i) for i in range(3)), strict=True):
                ends = cut_ends(marks.values.to_numpy(), n.as_py(), near, far)
                for a in range(0, len(ends), 100_000):
                    part = ends[a : a + 100_000]
                    starts = np.append(ends[a - 1] if a else 0, part[:-1]) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([trace.as_py()] * len(part), pa.string()), pa.array(np.arange(a + 1, a + 1 + len(part))), pa.array(starts), pa.array(part)], names=["trace", "seg", "st", "en"])

    return per_trace.select("trace", "n", "marks").mapInArrow(fold, "trace string, seg long, st long, en long")


def numbered(segments: DataFrame) -> DataFrame:
    """Add `seg_id`, from 1 in (trace, seg) order, by way of one count per trace."""
    counts = segments.groupBy("trace").agg(F.count("*").alias("n"))
    before = counts.select("trace", (F.sum("n").over(Window.orderBy("trace")) - F.col("n")).alias("before"))  # a row per trace
    return segments.join(before, "trace").withColumn("seg_id", F.col("before") + F.col("seg")).drop("before")


def segments(chunks: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (seg_id, trace, seg, st, en, seg_size) from positioned chunks."""
    out = numbered(cuts(chunks, cfg))
    return out.select("seg_id", "trace", "seg", "st", "en", (F.col("en") - F.col("st") + 1).alias("seg_size"))


def members(chunks: DataFrame, segs: DataFrame) -> DataFrame:
    """Rows (seg_id, trace, i, seg_size, fp): the chunks of every segment, i from 0."""
    places = segs.select("seg_id", "trace", "st", "seg_size", F.explode(F.sequence("st", "en")).alias("pos"))
    joined = places.join(chunks.select("trace", "pos", "fp"), ["trace", "pos"])
    return joined.select("seg_id", "trace", (F.col("pos") - F.col("st")).alias("i"), "seg_size", "fp")
