"""Packing of tokenised documents into windows of equal capacity.

Documents are tokenised once, in a map. A document's ids are cut into whole windows, which
need no packing, and a rest, cut into pieces of `piece` ids at most. Pieces, not ids, are
shuffled: (document, start, length, checksum). Groups of pieces worth about `group` windows
are divided by Karmarkar-Karp differencing; while a window exceeds the capacity, the group
gets one window more.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadup.llm.bpe_counts import byte_alphabet
from stratadup.llm.textkit import column, pick, released, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ByteBpe:
    """Ids of a byte-level vocabulary, as little-endian unsigned 32-bit integers.

    Where merged pieces are numbered in the order of their merges, the faster of two libraries
    gives the same ids (its pattern is the usual one of such vocabularies); other vocabularies go
    through the library that their file is meant for. Nothing is remembered between texts.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.quick = Tokenizer.from_file(path), None
        with open(path) as f:
            spec = json.load(f)
        if self._in_merge_order(spec):
            import tiktoken

            byte_of = {c: b for b, c in enumerate(byte_alphabet())}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
            self.quick = tiktoken.Encoding("byte_bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def _in_merge_order(spec: dict) -> bool:
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [model["vocab"][x + y] for x, y in pairs]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec["normalizer"] is None
        usual = not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) and not model.get("ignore_merges")
        return bool(plain and usual and merged == sorted(set(merged)) and len(model["vocab"].keys() - {t["content"] for t in spec["added_tokens"]}) == 256 + len(pairs) and merged[:1] == [256])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text."""
        for text in texts:
            ids = self.quick.encode(text, allowed_special="all") if self.quick else self.library.encode(text, add_special_tokens=False).ids
            yield np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def cuts(total: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of whole windows, then of the rest's pieces, which are about equal."""
    whole = total // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    rest, start = total - whole * capacity, whole * capacity
    n = -(-rest // piece)
    for i in range(n):
        length = rest // n + (i < rest % n)
        out.append((start, length))
        start += length
    return out


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of every item, by Karmarkar-Karp's multiway differencing.

    A partial partition keeps its windows' sums in falling order, less the least. The two with
    the widest spread merge, one's large sums meeting the other's small ones.
    """
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    blank = np.zeros(windows, np.int64)
    nodes: list[tuple] = []
    heap = []
    for i, size in enumerate(sizes):
        sums = blank.copy()
        sums[0] = size
        nodes.append((i,))
        heap.append((-int(size), i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), len(nodes) - 1, sums))
    out = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(windows))]
    while todo:
        k, label = todo.pop()
        node = nodes[k]
        if len(node) == 1:
            out[node[0]] = label[0]
            continue
        a, b, order = node
        of_a, of_b = np.empty_like(label), np.empty_like(label)
        of_a[order] = label
        of_b[windows - 1 - order] = label
        todo += [(a, of_a), (b, of_b)]
    return out


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of one group's pieces; the count of windows rises until none is too full."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        label = differencing(sizes, windows)
        if np.bincount(label, sizes, windows).max() <= capacity:
            return label
        windows += 1


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, piece: int = 256, group: int = 96, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """One row per piece: its document, place, checksum, sequence and offset.

    A null text counts as empty; its document is the end id alone. Ids pass through, null ones
    too; rows that repeat an id are documents of their own. Pieces are dealt out by a hash of
    their fields; where equal rows gather at one hash, the partition is cut by the map tasks that
    wrote it, and every task streams through groups of bounded size. A text is tokenised whole,
    however long. Further columns of the table are ignored, whatever their names.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                total, view = len(ids) // 4, memoryview(ids)
                for start, length in cuts(total, capacity, piece):
                    for c, v in zip(out, (doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        held: list[pa.RecordBatch] = []
        tokens = 0
        room = int(group * capacity * 0.998)

        def close(table: pa.Table) -> pa.RecordBatch:
            nonlocal sequence
            sizes = table["length"].to_numpy()
            label = pack_group(sizes, capacity)
            order = np.argsort(label, kind="stable")
            counts = np.bincount(label)
            offset = np.empty(len(sizes), np.int64)
            run = np.cumsum(sizes[order]) - sizes[order]
            heads = np.cumsum(counts) - counts
            offset[order] = run - np.repeat(run[heads[counts > 0]], counts[counts > 0])
            dense = np.cumsum(counts > 0) - 1
            ids = sequence + dense[label]
            sequence += int((counts > 0).sum())
            return table.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).combine_chunks().to_batches()[0]

        for batch in batches:
            batch = batch.select(names)
            lengths = column(batch, "length").to_numpy()
            full = lengths == capacity
            if full.any():
                whole = pa.Table.from_batches([batch]).filter(pa.array(full))
                ids = np.arange(sequence, sequence + whole.num_rows)
                sequence += whole.num_rows
                yield whole.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(np.zeros(len(ids), np.int64))).combine_chunks().to_batches()[0]
                batch = pa.Table.from_batches([batch]).filter(pa.array(~full)).combine_chunks()
                if not batch.num_rows:
                    continue
                batch = batch.to_batches()[0]
                lengths = lengths[~full]
            total, begin = np.concatenate(([0], np.cumsum(lengths))), 0
            while begin < len(lengths):
                end = int(np.searchsorted(total, total[begin] + room - tokens, "right")) - 1
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
                    tokens += int(total[end] - total[begin])
                    begin = end
                if begin < len(lengths):
                    yield close(pa.Table.from_batches(held))
                    held, tokens = [], 0
        if held:
            yield close(pa.Table.from_batches(held))

    if piece > capacity:
        raise ValueError("a piece must fit into a window")
    docs = pick(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    pieces = rows.mapInArrow(released(tokenise), PIECES)
    by = F.xxhash64("doc_id", "start", "length", "ids_crc32")
    if partitions is None:  # as many as the pieces need: small partitions join, large ones are cut
        dealt = pieces.withColumn("by", by).hint("rebalance", "by").drop("by")
    else:
        dealt = pieces.repartition(partitions, by)
    dealt = dealt.sortWithinPartitions(by, "doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.mapInArrow(released(assign), PIECES + ", sequence_id long, offset long")
