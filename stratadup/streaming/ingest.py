"""Segments as a stream: routing, exact deduplication and live reports.

Routing keeps its state per client in the state store, so a restarted query goes on where its
checkpoint ends; segments of a batch are taken in seg_id order, batches in order of arrival.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratadup.config import RoutingConfig
from stratadup.operators.fold import DECISION, Router, names


def route(segments: DataFrame, cfg: RoutingConfig, client: str | None = None) -> DataFrame:
    """Decisions for a stream of packed segments (seg_id, fea, fps)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        router = pickle.loads(state.get[0]) if state.exists else Router(cfg)
        pdf = pd.concat(list(frames)).sort_values("seg_id")
        rows = [router.route(int(s), list(f), list(p)) for s, f, p in zip(pdf["seg_id"], pdf["fea"], pdf["fps"], strict=True)]
        state.update((pickle.dumps(router),))
        yield pd.DataFrame(rows, columns=names())

    keyed = segments.withColumn("client", F.col(client).cast("string") if client else F.lit("0"))
    return keyed.groupBy("client").applyInPandasWithState(step, DECISION, "state binary", "append", GroupStateTimeout.NoTimeout)


def new_fingerprints(chunks: DataFrame, scope: str | None = None) -> DataFrame:
    """Chunks whose fingerprint was not seen before, in the whole stream or per `scope`."""
    return chunks.dropDuplicates([scope, "fp"] if scope else ["fp"])


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Running chunks per trace, for output mode `update` or `complete`."""
    return chunks.groupBy("trace").agg(F.count("*").alias("chunks"))
