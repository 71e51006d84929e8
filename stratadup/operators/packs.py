"""Segments as one row each, for plans that read the chunks of a stream more than once.

A stream is sorted once into runs of neighbouring chunks; a fold over the runs' boundary
positions cuts them, and the cut runs are put together by segment. Fingerprints are kept as one
string of 12 digits each, and written twice to the shared folder: by run and by segment. Members,
features and decisions are then computed row by row, without another join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadup.config import RoutingConfig
from stratadup.durable import durable
from stratadup.functions.fingerprints import DIGITS, MULTIPLIERS, OFFSETS, SPAN

#: What stands for a null fingerprint in a row, and as a number: after all others.
NONE, NONE_KEY = "~" * DIGITS, SPAN
#: Chunks of a run at most; a batch of 10,000 runs then has 30 MB.
LONGEST = 256
#: Rows of a table that are unpacked at a time.
READ_ROWS = 256
#: Shuffled bytes that are put together in a partition, compressed; sorted, they take about five times as much.
PART_BYTES = 4 << 20
_NIBBLE = np.zeros(256, np.uint8)
_NIBBLE[list(b"0123456789abcdef")] = np.arange(16)
_DIGIT = np.frombuffer(b"0123456789abcdef", np.uint8)


def _octets(fps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all fingerprints of a column, a row of 6 for each, and which ones are null."""
    if not len(fps):
        return np.empty((0, 6), np.uint8), np.empty(0, bool)
    bounds = np.frombuffer(fps.buffers()[1], np.int32)[fps.offset : fps.offset + len(fps) + 1]
    digits = np.frombuffer(fps.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].reshape(-1, DIGITS)
    half = _NIBBLE[digits]
    return half[:, 0::2] << 4 | half[:, 1::2], digits[:, 0] == ord(NONE[0])


def keys_of(fps: pa.Array) -> np.ndarray:
    """All fingerprints of a column as numbers, which sort like the digits."""
    octets, none = _octets(fps)
    wide = np.zeros((len(octets), 8), np.uint8)
    wide[:, 2:] = octets
    keys = wide.view(">u8").ravel().astype(np.uint64)
    keys[none] = NONE_KEY
    return keys


def _little_endian(keys: np.ndarray) -> np.ndarray:
    """The same bytes, lowest first."""
    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, :6] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return wide.view("<u8").ravel()


def _marks(keys: np.ndarray, span: int) -> np.ndarray:
    """Which fingerprints are boundaries; see `is_boundary`."""
    return ((_little_endian(keys) & np.uint64(0xFFFFFFFF)) % np.uint64(span) == 0) & (keys != NONE_KEY)


def digits_of(keys: np.ndarray) -> pa.Array:
    octets = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    digits = np.empty((len(keys), DIGITS), np.uint8)
    digits[:, 0::2], digits[:, 1::2] = _DIGIT[octets >> 4], _DIGIT[octets & 15]
    ends = np.arange(len(keys) + 1, dtype=np.int32) * DIGITS
    valid = keys != NONE_KEY
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(keys), [mask, pa.py_buffer(ends), pa.py_buffer(digits)])


def runs(chunks: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (part, run, trace, n, fps, marks): neighbours in (trace, file_no, chunk_no, fp) order;
    `marks` are the boundary chunks of a run, from 1. A null trace is the one with the empty name."""
    order = ["trace", "file_no", "chunk_no", "fp"]
    ordered = chunks.withColumn("trace", F.coalesce("trace", F.lit(""))).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            trace, fps, n = batch.column(0), pc.fill_null(batch.column(1), NONE), batch.num_rows
            if not n:
                continue
            turn = np.flatnonzero(pc.not_equal(trace[1:], trace[:-1]).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([np.unique(np.concatenate([turn, np.arange(0, n, LONGEST)])), [n]])
            marked = np.flatnonzero(_marks(keys_of(fps), cfg.least))
            at = np.searchsorted(marked, starts)
            sizes = np.diff(starts)
            first = np.frombuffer(fps.buffers()[1], np.int32)[fps.offset]
            text = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer((first + starts * DIGITS).astype(np.int32)), fps.buffers()[2]])
            marks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(marked + 1 - np.repeat(starts[:-1], np.diff(at)), pa.int32()))
            k = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * k, pa.int32()), pa.array(range(run, run + k), pa.int32()), trace.take(pa.array(starts[:-1])), pa.array(sizes, pa.int32()), text, marks],
                names=["part", "run", "trace", "n", "fps", "marks"],
            )
            run += k

    return ordered.select("trace", "fp").mapInArrow(pack, "part int, run int, trace string, n int, fps string, marks array<int>")


class Cutter:
    """Cuts a trace run by run; a segment ends at a boundary once it has the least size, or at the greatest."""

    def __init__(self, near: int, far: int):
        self.near, self.far, self.seg, self.held = near, far, 1, 0  # chunks of the open segment so far

    def cut(self, marks: list[int], n: int) -> list[int]:
        """Ends of segments among the run's chunks, from 1."""
        ends, start = [], 1 - self.held
        for mark in [*marks, None]:
            upto = n if mark is None else mark
            forced = (upto - start + 1) // self.far
            if forced > 0:
                ends.extend(range(start + self.far - 1, start + forced * self.far, self.far))
                start += forced * self.far
            if mark is not None and mark - start + 1 >= self.near:
                ends.append(mark)
                start = mark + 1
        self.held = n + 1 - start
        self.seg += len(ends)
        return ends


def cuts(found: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (part, run, trace, seg, held, last, ends): the segment of a run's first chunk, how many
    chunks of it lie in earlier runs, the segment of its last chunk, and the ends in the run."""
    ordered = found.select("trace", "part", "run", "n", "marks").repartition("trace").sortWithinPartitions("trace", "part", "run")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, cutter = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if cutter is None or r["trace"] != trace:
                    trace, cutter = r["trace"], Cutter(cfg.least, cfg.most)
                seg, held = cutter.seg, cutter.held
                ends = cutter.cut(r["marks"], r["n"])
                rows.append((r["part"], r["run"], trace, seg, held, cutter.seg - (cutter.held == 0), ends))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=["part", "run", "trace", "seg", "held", "last", "ends"])

    return ordered.mapInArrow(fold, "part int, run int, trace string, seg long, held int, last long, ends array<int>")


def packed(chunks: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (seg_id, seg_size, fps) of a stream (trace, file_no, chunk_no, fp)."""
    found = durable(runs(chunks, cfg), READ_ROWS, PART_BYTES)
    cut = durable(cuts(found, cfg), part_bytes=PART_BYTES)
    counts = cut.groupBy("trace").agg(F.max("last").alias("n"))
    before = counts.select("trace", (F.sum("n").over(Window.orderBy("trace")) - F.col("n")).alias("before"))  # a row per trace
    placed = cut.join(before, "trace").select("part", "run", (F.col("before") + F.col("seg")).alias("seg"), "held", "ends")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0)
            for k, (n, seg, held, ends) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)):
                at = np.array([0, *ends, *([n] if not ends or ends[-1] < n else [])], np.int32)
                first = np.frombuffer(fps.buffers()[1], np.int32)[fps.offset + k]
                text = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(first + at * np.int32(DIGITS)), fps.buffers()[2]])
                skipped = np.zeros(len(at) - 1, np.int32)
                skipped[0] = held
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(seg, seg + len(at) - 1)), pa.array(skipped), text], names=["seg_id", "skipped", "fps"])

    # both sides grow with the input, so neither is sent to the driver
    pieces = found.join(placed.hint("merge"), ["part", "run"]).select("fps", "n", "seg", "held", "ends").mapInArrow(split, "seg_id long, skipped int, fps string")
    whole = pieces.groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("skipped", "fps"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["fps"]), "")
    rows = whole.select("seg_id", text.alias("fps"))
    return durable(rows.select("seg_id", F.expr(f"octet_length(fps) div {DIGITS}").alias("seg_size"), "fps"), part_bytes=PART_BYTES)


def members(packs: DataFrame) -> DataFrame:
    """Rows (seg_id, i, seg_size, fp), i from 0; other columns of the segments stay."""
    others = [c for c in packs.columns if c not in ("seg_id", "seg_size", "fps")]
    each = packs.select("seg_id", *others, "seg_size", F.col("fps").cast("binary").alias("fps"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("seg_size") - 1)).alias("i"))
    fp = F.expr(f"cast(substring(fps, cast({DIGITS} * i + 1 as int), {DIGITS}) as string)")
    return each.select("seg_id", *others, "i", "seg_size", F.nullif(fp, F.lit(NONE)).alias("fp"))


def counted(packs: DataFrame) -> DataFrame:
    """Rows (node, fp, n) of placed segments: how often a node gets a fingerprint, as a number, from
    neighbouring segments; the rows of one fingerprint are still to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                nodes, sizes, fps = batch.slice(a, 1000).columns
                keys, at = keys_of(fps), np.repeat(nodes.to_numpy(zero_copy_only=False), sizes.to_numpy())
                order = np.lexsort((keys, at))
                keys, at = keys[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])])[: len(keys)])
                times = np.diff(np.append(first, len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(at[first], pa.int32()), pa.array(keys[first].astype(np.int64)), pa.array(times, pa.int64())], names=["node", "fp", "n"])

    return packs.select("node", "seg_size", "fps").mapInArrow(run, "node int, fp long, n long")


def on_nodes(packs: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Segments with the node of stateless routing, which follows from their first chunk."""
    byte = F.conv(F.nullif(F.substring("fps", 1, 2), F.lit(NONE[:2])), 16, 10).cast("long")
    return packs.withColumn("node", F.pmod(byte, F.lit(cfg.nodes)).cast("int"))


def stateless(packs: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (seg_id, node) of stateless routing."""
    return on_nodes(packs, cfg).select("seg_id", "node")


def _leading(at: np.ndarray, count: int) -> np.ndarray:
    """Places of groups of neighbours that begin at `at`, of `count` in all."""
    return np.arange(count) - np.repeat(at, np.diff(np.append(at, count)))


def chosen(keys: np.ndarray, sizes: np.ndarray, cfg: RoutingConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, fea_pos, feature) of neighbouring segments of `sizes`; see `features` for the methods."""
    f, n = cfg.features, len(keys)
    starts = np.cumsum(sizes) - sizes
    seg, i = np.repeat(np.arange(len(sizes)), sizes), _leading(starts, n)
    if cfg.feature == "first":
        return np.arange(len(sizes)), np.zeros(len(sizes), np.int64), keys[starts]
    short = np.repeat(sizes <= f, sizes)
    s, j, k, size = seg[~short], i[~short], keys[~short], np.repeat(sizes, sizes)[~short]
    if not len(s):
        return seg, i, keys
    if cfg.feature == "mink":
        order = np.lexsort((j, k, s))
        keep = j < f  # places are the same in every order of a segment
        out = s[keep], j[keep], k[order][keep]
    elif cfg.feature == "ntrans":
        at = np.flatnonzero(j == 0)
        value, best = _little_endian(k), []
        for m in range(f):
            v = ((value * np.uint64(MULTIPLIERS[m] % SPAN) + np.uint64(OFFSETS[m] % SPAN)) & np.uint64(SPAN - 1)).astype(np.int64)
            v[k == NONE_KEY] = -1
            top = np.flatnonzero(v == np.repeat(np.maximum.reduceat(v, at), np.diff(np.append(at, len(v)))))
            best.append(k[top[np.unique(s[top], return_index=True)[1]]])  # the first on a tie
        out = np.repeat(s[at], f), np.tile(np.arange(f), len(at)), np.stack(best, 1).ravel()
    else:
        if cfg.feature == "finesse":
            part = np.minimum(j // (size // f), f - 1)
        else:
            mark = np.cumsum(_marks(k, max(cfg.segment // f, 1)) & (j > 0))
            begin = np.flatnonzero(j == 0)
            part = np.minimum(mark - np.repeat(mark[begin], np.diff(np.append(begin, len(mark)))), cfg.least - 1)
        at = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (part[1:] != part[:-1])]))
        s, part, k = s[at], part[at], np.minimum.reduceat(k, at)
        if cfg.feature == "cdmink":
            begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            count = np.diff(np.append(begin, len(s)))
            many = np.repeat(count > f, count)
            order = np.lexsort((part, np.where(many, k, 0), s))
            k, place = k[order], _leading(begin, len(s))
            part = np.where(many, place, part)
            keep = ~many | (place < f)
            s, part, k = s[keep], part[keep], k[keep]
        out = s, part, k
    return tuple(np.concatenate([a, b[short]]) for a, b in zip(out, (seg, i, keys), strict=True))


def features(packs: DataFrame, cfg: RoutingConfig) -> DataFrame:
    """Rows (seg_id, fea_pos, fea); a node of the segments stays."""
    others = [c for c in packs.columns if c == "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                sizes, fps, *kept = batch.slice(a, 1000).columns
                seg, place, keys = chosen(keys_of(fps), sizes.to_numpy(), cfg)
                at = pa.array(seg)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in kept), pa.array(place, pa.int64()), digits_of(keys)], names=["seg_id", *others, "fea_pos", "fea"])

    return packs.select("seg_size", "fps", "seg_id", *others).mapInArrow(run, ", ".join(["seg_id long", *(f"{c} int" for c in others), "fea_pos long, fea string"]))
