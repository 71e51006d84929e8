"""Connected components of a graph given as edges.

Graphs of up to `SMALL` different edges (16 bytes each) are solved by one task; larger ones by
alternating star contractions. Both name a component by its least node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadup.llm.durable import durable


SMALL = 500_000


def solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), and every node's least reachable node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        node, component = solve(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """Rows (node, component) for every node of an edge; the component is its least node.

    Each round points the larger neighbours of a node at its least neighbour, then the smaller
    ones, until nothing changes. A node's neighbours meet only in aggregates and joins.
    """
    e = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    mark = _mark(e)
    if mark[0] <= small:
        return e.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = durable(after)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Tells edge sets apart: their number and the sums of two hashes."""
    sums = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(edges.agg(F.count("*"), *sums).first())
