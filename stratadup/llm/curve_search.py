"""Approximate largest inner products by shifted space-filling curves.

Vectors get one coordinate more, so that all have the length of the longest and the nearest
point to a lengthened query is the one with the largest inner product. Several curves order
them: each projects on random directions, shifts at random, and takes the Hilbert index of the
grid cell. Rows are range-partitioned by (curve, index) and cut into blocks of `block` vectors.
On each curve a query meets its own block and so many on either side that they hold `share` of
all vectors, one on each side at least: recall follows the share, not the number of vectors.
Every block keeps the query's best; the blocks of all curves merge.

Equal vectors are searched as one, with as many of their least ids as a result can hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadup.llm.durable import durable
from stratadup.llm.textkit import column, pick

_U = np.uint64


@dataclass(frozen=True)
class Curves:
    """`dims` * `bits` is below 64; a query meets `share` of the vectors on a curve, or three blocks."""

    count: int = 12
    dims: int = 8
    bits: int = 7
    block: int = 2048
    share: float = 0.1
    seed: int = 17

    def reach(self, n: int) -> int:
        """Blocks on either side of a query's own."""
        return max(1, math.ceil((self.share * n / self.block - 1) / 2))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of every grid cell along the Hilbert curve; a row is a cell's coordinates.

    Coordinates are turned into the curve's transposed index from the highest bit on: where a
    coordinate's bit is set the lower bits of the first coordinate are mirrored, else they are
    exchanged with that coordinate's; the Gray code is then undone and the bits interleaved.
    """
    axes = list(np.ascontiguousarray(cells.T).astype(_U))
    for b in range(bits - 1, 0, -1):
        bit, below = _U(1 << b), _U((1 << b) - 1)
        for i in range(len(axes)):
            on = (axes[i] & bit) != 0
            swap = np.where(on, _U(0), (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(on, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((axes[-1] & _U(1 << b)) != 0, flip ^ _U((1 << b) - 1), flip)
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << _U(1) | ((axis ^ flip) >> _U(b)) & _U(1)
    return key


def matrix(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy().astype(np.float64)
    return values.reshape(len(vectors), -1) if len(vectors) else values.reshape(0, 0)


def _directions(curves: Curves, dim: int) -> np.ndarray:
    return np.random.RandomState(curves.seed).normal(size=(dim + 1, curves.count * curves.dims))


def _lengthened(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors of one dimension more; a query's own length does not matter."""
    norm = np.sqrt((x * x).sum(1))
    if query:
        return np.hstack((x / norm[:, None], np.zeros((len(x), 1))))
    return np.hstack((x / longest, np.sqrt(np.maximum(1 - (norm / longest) ** 2, 0))[:, None]))


def _inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal vectors give equal results, wherever they stand."""
    return (q * x).sum(1)


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v): vectors without null or non-finite components, not zero."""
    table = pick(table, key, vector).toDF("id", "v")
    rows = table.select(F.col("id").cast("long").alias("id"), "v").where("id is not null and v is not null and size(v) > 0")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))


def search(table: DataFrame, key: str, vector: str, is_query, k: int, curves: Curves = Curves()) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for every valid vector whose id satisfies `is_query`.

    `is_query` makes a condition from the id's column. Null ids and unusable vectors take no
    part; vectors of another length are no candidates of a query, and every length is searched by
    itself. Repeated rows count once; of equal scores the smaller ids come first, and none is cut
    before. An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    rows = valid_vectors(table, key, vector)
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().collect()]  # a row per length
    found = [_search(rows.where(F.size("v") == n), is_query, k, curves) for n in sorted(lengths)]
    empty = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else empty


def _search(rows: DataFrame, is_query, k: int, curves: Curves) -> DataFrame:
    kind = dict(rows.dtypes)["v"]
    unique = rows.dropDuplicates(["v", "id"])
    ranked = unique.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    copies = durable(ranked.withColumn("group", F.min("id").over(Window.partitionBy("v"))).select("group", "id", "v"))
    points = copies.where("id = group").select("group", "v")
    wanted = durable(rows.where(is_query(F.col("id"))).dropDuplicates(["v", "id"]).join(points, "v").select("group", F.col("id").alias("query_id")))
    n, dim, longest, centre, scale = _facts(points, curves)
    found = _windows(points, wanted.select("group").distinct(), kind, n, dim, longest, centre, scale, k, curves)

    best = found.groupBy("q", "group").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "group")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    each = best.join(copies.select("group", "id"), "group").select("q", "id", "score")
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    lists = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))  # k + 1 at most
    others = wanted.join(lists, F.col("group") == F.col("q")).select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    out = others.select("query_id", F.posexplode("near").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _facts(points: DataFrame, curves: Curves):
    """Number, dimension, greatest length, and the projections' means and deviations, over all rows."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(column(batch, "v"))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([x.shape[1]], pa.int64()), pa.array([float(np.sqrt((x * x).sum(1)).max())])], names=["n", "dim", "longest"])

    one = points.mapInArrow(norms, "n long, dim long, longest double").agg(F.sum("n"), F.max("dim"), F.max("longest")).first()
    n, dim, longest = one
    r = _directions(curves, dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _lengthened(matrix(column(batch, "v")), longest, False) @ r
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.shape[1])), pa.array(p.sum(0)), pa.array((p * p).sum(0))], names=["i", "s", "q"])

    got = points.mapInArrow(sums, "i long, s double, q double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").toPandas()
    centre = got["s"].to_numpy() / n
    scale = np.sqrt(np.maximum(got["q"].to_numpy() / n - centre**2, 1e-18))
    return n, dim, longest, centre, scale


def _windows(points, query_groups, kind, n, dim, longest, centre, scale, k, curves) -> DataFrame:
    """Rows (q, group, score): the best of every block that a query meets."""
    r = _directions(curves, dim)
    shift = np.random.RandomState(curves.seed + 1).uniform(-0.5, 0.5, curves.count * curves.dims)
    top = (1 << curves.bits) - 1

    def keys(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    z = (_lengthened(matrix(column(part, "v")), longest, query) @ r - centre) / scale + shift
                    cells = np.clip((z + 4.5) / 9 * (top + 1), 0, top).astype(np.int64)
                    for c in range(curves.count):
                        key = hilbert(cells[:, c * curves.dims : (c + 1) * curves.dims], curves.bits)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, c, np.int32)), pa.array(key.astype(np.int64)), column(part, "group"), pa.array(np.full(part.num_rows, query)), column(part, "v")], names=["curve", "key", "group", "query", "v"])

        return run

    shape = f"curve int, key long, group long, query boolean, v {kind}"
    asked = points.join(query_groups, "group").select("group", "v")
    rows = points.mapInArrow(keys(False), shape).unionByName(asked.mapInArrow(keys(True), shape))
    parts = max(1, -(-n * curves.count // (8 * curves.block)))
    dealt = rows.repartitionByRange(parts, "curve", "key", "group").sortWithinPartitions("curve", "key", "group", "query")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, units, first, after, last = TaskContext.get().partitionId(), 0, 0, 0, None
        for batch in batches:
            curve, query = column(batch, "curve").to_numpy(), column(batch, "query").to_numpy(zero_copy_only=False)
            out = np.empty(len(curve), np.int32)
            # a block is full with `block` vectors or four times as many queries
            weight = np.where(query, 1, 4)
            edge = [0, *(np.flatnonzero(np.diff(curve)) + 1).tolist(), len(curve)]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                if curve[a] != last:
                    last, units, first = curve[a], 0, after
                run = np.cumsum(weight[a:b])
                out[a:b] = first + (units + run - weight[a:b]) // (4 * curves.block)
                units, after = units + int(run[-1]), int(out[b - 1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), part, np.int32)), pa.array(out), column(batch, "group"), column(batch, "query"), column(batch, "v")], names=["part", "block", "group", "query", "v"])

    ordered = durable(dealt.mapInArrow(number, f"part int, block int, group long, query boolean, v {kind}"))
    blocks = ordered.groupBy("part").agg((F.max("block") + 1).cast("long").alias("n"))  # one row per partition
    first = blocks.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    placed = ordered.join(F.broadcast(first), ordered["part"] == first["_part"]).withColumn("at", F.col("first") + F.col("block"))
    reach = curves.reach(n)
    near = F.when(F.col("query"), F.sequence(F.col("at") - reach, F.col("at") + reach)).otherwise(F.array("at"))
    placed = placed.select(F.explode(near).alias("at"), "group", "query", "v")

    def window(table: pa.Table) -> pa.Table:
        """The k + 1 best of a block for each query, by (score, id). The matrix product only leaves
        out what is below the last of these by more than its rounding."""
        table = table.combine_chunks()
        asks = table["query"].to_numpy()
        group = table["group"].to_numpy()
        v = matrix(table["v"].combine_chunks())
        q, x = v[asks], v[~asks]
        qs, xs = group[asks], group[~asks]
        order = np.argsort(xs, kind="stable")
        x, xs = x[order], xs[order]
        largest = np.sqrt((x * x).sum(1).max()) if len(x) else 0.0
        out: list[list[np.ndarray]] = [[], [], []]
        m = min(k + 1, len(x))
        for a in range(0, len(q) if len(x) else 0, 256):
            part = q[a : a + 256]
            rough = part @ x.T
            slack = np.sqrt((part * part).sum(1)) * largest * (x.shape[1] + 8) * 2.0**-51
            least = np.partition(rough, len(x) - m, axis=1)[:, len(x) - m] - slack
            rows, at = np.nonzero(rough >= least[:, None])
            score = _inner(part[rows], x[at])
            by = np.lexsort((at, -score, rows))
            rows, at, score = rows[by], at[by], score[by]
            place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(part)))[rows]
            best = place < m
            out[0].append(qs[a : a + 256][rows[best]])
            out[1].append(xs[at[best]])
            out[2].append(score[best])
        cat = lambda c, t: pa.array(np.concatenate(c) if c else np.zeros(0), t)
        return pa.table({"q": cat(out[0], pa.int64()), "group": cat(out[1], pa.int64()), "score": cat(out[2], pa.float64())})

    return placed.groupBy("at").applyInArrow(window, "q long, group long, score double")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact (query_id, vec_id) pairs that were found."""
    hit = exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, exact.count())
