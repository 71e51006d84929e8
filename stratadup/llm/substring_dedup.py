"""Removal of passages that also occur in documents with smaller ids.

A window is `size` consecutive words. Three passes over the texts:

1. Sketch. Equal windows have equal minimizers (the least hash of the window's inner
   `inner`-word grams), so a window's count is at most the number of documents with its
   minimizer. Every task counts the minimizers of its documents in a sparse count-min sketch:
   a row is a cell and a count. Cells of all tasks are summed by a shuffle.
2. Windows. The cells that count two documents or more are folded into one bit array per
   sketch row, of a size fixed by the number of such cells and by `max_bits`. Only windows
   whose cells are all set go on; they are grouped exactly, by 128-bit hashes, and windows
   that also start in a document with a smaller id leave their place. What the documents of a
   slice share is settled there: only the least of them goes on to the grouping, so a passage
   of very many documents sends one row per slice.
3. Removal. Places are gathered per row of the table (its id and a hash of its text) and its
   words are left out. Only texts that may have such places (by another bit array) travel
   through the join.

A full bit array lets more windows through to the exact grouping; it never loses one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratadup.llm import textkit
from stratadup.llm.durable import durable
from stratadup.llm.textkit import column, pick, released, signed

ROWS = 2
CELL_BITS = 32
SCRATCH = 4 << 20


def _minimizers(grams: np.ndarray, bounds: np.ndarray, span: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least gram hash of each window, the window's text and place, and its row in `grams`.

    `grams` holds the hash of the `inner` words from each word on; `span` words make a window.
    """
    counts = np.maximum(np.diff(bounds) - span + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = bounds[:-1][doc] + inside
    width, low, have = span - inner + 1, grams, 1
    while have * 2 <= width:  # low[i] is the least of `have` grams from i on
        low = np.minimum(low, np.append(low[have:], low[-have:]))
        have *= 2
    return np.minimum(low[at], low[at + width - have]), doc, inside, at


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from every word on; the last ones wrap and are not used."""
    out = np.zeros(len(hashes), np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.roll(hashes, -j)
        out ^= out >> np.uint64(31)
    return textkit.mix(out, 60)


def _cells(keys: np.ndarray) -> list[np.ndarray]:
    """The cell of each key in every row of the sketch."""
    return [textkit.mix(keys, 70 + r) >> np.uint64(64 - CELL_BITS) for r in range(ROWS)]


def sketch(docs: DataFrame, size: int, inner: int) -> DataFrame:
    """The merged sketch: rows (cell, n); a cell's high part is the row of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, limit=SCRATCH):
            words = textkit.split(column(batch, "text"))
            if not len(words.starts):
                continue
            least, doc, _, _ = _minimizers(_grams(words.hashes(), inner), words.bounds, size, inner)
            ids = column(batch, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            change = np.ones(len(least), bool)  # neighbouring windows mostly share a minimizer
            change[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            pairs = np.unique(np.stack((least[change], ids[change].view(np.uint64)), 1), axis=0)[:, 0] if change.any() else np.zeros(0, np.uint64)
            for r, cells in enumerate(_cells(pairs)):
                cell, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64) | (r << CELL_BITS)), pa.array(n.astype(np.int32))], names=["cell", "n"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n"))


class BitArrays:
    """Fixed-size sets of cells, one per row; a folded cell may stand for several."""

    def __init__(self, words: list[np.ndarray], bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def collect(cls, cells: DataFrame, rows: int, max_bits: int, per_cell: int = 16) -> BitArrays:
        """From rows (cell): at most rows * max_bits / 8 bytes reach the driver."""
        n = cells.count()
        bits = 1 << 12
        while bits < min(per_cell * max(n, 1) // rows, max_bits):
            bits *= 2
        place = F.col("cell").bitwiseAND(bits - 1)
        row = F.shiftright("cell", CELL_BITS).cast("int")
        word = F.shiftright(place, 6).cast("int")
        folded = cells.groupBy(row.alias("r"), word.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((cell & {bits - 1}) & 63 as int))")).alias("b"))
        found = folded.toArrow()
        words = [np.zeros(bits // 64, np.int64) for _ in range(rows)]
        r, w, b = (found[c].to_numpy() for c in ("r", "w", "b"))
        for i in range(rows):
            words[i][w[r == i]] = b[r == i]
        return cls([x.view(np.uint64) for x in words], bits)

    def has(self, row: int, cells: np.ndarray) -> np.ndarray:
        at = cells & np.uint64(self.bits - 1)
        return (self.words[row][(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _id_cells(ids: np.ndarray) -> np.ndarray:
    return textkit.mix(ids.astype(np.int64).view(np.uint64), 90) >> np.uint64(64 - CELL_BITS)


def row_hash(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(text)


def repeated_places(rows: DataFrame, size: int, inner: int, max_bits: int) -> DataFrame:
    """Rows (doc_id, row, places): windows there also start in a document with a smaller id.

    `rows` has (doc_id, row, text); a row of the result is a part of a row's places.
    """
    spark = rows.sparkSession
    heavy = durable(sketch(rows, size, inner).where("n > 1").select("cell"))
    seen = spark.sparkContext.broadcast(BitArrays.collect(heavy, ROWS, max_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = seen.value
        for batch in textkit.slices(batches, limit=SCRATCH):
            words = textkit.split(column(batch, "text"))
            if not len(words.starts):
                continue
            hashes = words.hashes()
            least, doc, inside, _ = _minimizers(_grams(hashes, inner), words.bounds, size, inner)
            on = np.ones(len(least), bool)
            for r, cells in enumerate(_cells(least)):
                on &= marked.has(r, cells)
            if not on.any():
                continue
            del least
            doc, inside = doc[on], inside[on]
            a = textkit.windows(hashes, words.bounds, size, 0)[0][on]
            b = textkit.windows(words.hashes(1), words.bounds, size, 1)[0][on]
            ids = column(batch, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            by = _settled(a, b, ids[doc])
            yield _row_places(column(batch, "doc_id"), column(batch, "row"), doc[by], inside[by])
            # the others, in order of window and document: a document's places of a window are one row
            left = np.flatnonzero(~by)
            left = left[np.lexsort((inside[left], doc[left], b[left], a[left]))]
            a, b, doc, inside = a[left], b[left], doc[left], inside[left]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.append(head, len(a)).astype(np.int32)), pa.array(inside.astype(np.int32)))
            at = pa.array(doc[head])
            yield pa.RecordBatch.from_arrays([pa.array(signed(a[head])), pa.array(signed(b[head])), column(batch, "doc_id").take(at), column(batch, "row").take(at), places, pa.array(np.zeros(len(head), bool))], names=WINDOW)

    found = rows.mapInArrow(released(run), "a long, b long, doc_id long, row long, places array<int>, settled boolean")
    # one row for a window and slice, or more where rows repeat an id
    first = F.min("doc_id").over(Window.partitionBy("a", "b"))
    return found.withColumn("first", first).where(F.col("settled") | (F.col("doc_id") > F.col("first"))).select("doc_id", "row", "places")


WINDOW = ["a", "b", "doc_id", "row", "places", "settled"]


def _settled(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows also start in a document with a smaller id, among these alone."""
    order = np.lexsort((ids, b, a))
    x, y = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    least = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    out = np.zeros(len(a), bool)
    out[order] = ids[order] > least
    return out


def _row_places(ids: pa.Array, rows: pa.Array, doc: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
    """One row per document with all its settled places, under a key of its own."""
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    places = pa.ListArray.from_arrays(pa.array(np.append(head, len(doc)).astype(np.int32)), pa.array(inside.astype(np.int32)))
    at = pa.array(doc[head])
    own = ids.take(at)
    return pa.RecordBatch.from_arrays([own, rows.take(at), own, rows.take(at), places, pa.array(np.ones(len(head), bool))], names=WINDOW)


def remove_repeats(docs: DataFrame, size: int = 50, inner: int = 8, max_bits: int = 1 << 28, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept) and the columns `keep`, one per row.

    `kept` holds the kept words, joined by one space, and is null where nothing was removed.
    Windows are judged on the input texts. Null and empty texts have no words. Rows that repeat
    an id are one document where ids are compared, so they never remove from each other; each
    loses its own places only. A null id counts as the least of all (as -2**63 does). A text is
    hashed whole, in blocks, however long; its words' hashes are held at once. Columns that are
    not in `keep` are ignored, whatever their names.
    """
    names = [c for c in keep if c not in ("doc_id", "text")]
    docs = pick(docs, "doc_id", "text", *names)
    kinds = dict(docs.dtypes)
    text = docs["text"].cast("string")
    whole = docs.select(docs["doc_id"].alias("id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("doc_id"), row_hash(text).alias("row"), text.alias("text"), *[docs[c].alias(f"x{i}") for i, c in enumerate(names)])
    rows = whole.select("doc_id", "row", "text")
    places = repeated_places(rows, size, inner, max_bits)
    cut = durable(places.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places")))
    spark = docs.sparkSession

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_id_cells(batch.column(0).to_numpy()).astype(np.int64))], names=["cell"])

    cells = cut.select("doc_id").mapInArrow(cell_of, "cell long")
    touched = spark.sparkContext.broadcast(BitArrays.collect(cells, 1, max_bits))
    others = [f"x{i}" for i in range(len(names))]
    every = "text" in keep

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = touched.value
        for batch in textkit.slices(batches):
            maybe = marked.has(0, _id_cells(column(batch, "doc_id").to_numpy()))
            count, sums = [], []
            for text in column(batch, "text"):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                count.append(len(words))
                sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            texts = column(batch, "text") if every else column(batch, "text").take(pa.array(np.arange(len(maybe)), mask=~maybe))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "doc_id"), column(batch, "row"), pa.array(count, pa.int64()), pa.array(sums, pa.string()), texts, *[column(batch, c) for c in others]], names=["id", "doc_id", "row", "n_words", "whole_sha256", "text", *others])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches):
            removed, sums, kept = [], [], []
            for text, whole, places in zip(column(batch, "text"), column(batch, "whole_sha256").to_pylist(), column(batch, "places"), strict=True):
                if not places.is_valid:
                    removed.append(0), sums.append(whole), kept.append(None)
                    continue
                words = text.as_buffer().to_pybytes().split()
                at = np.asarray(places.values)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                stay = np.cumsum(edge[:-1]) == 0
                left = b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])
                removed.append(int(len(words) - stay.sum())), sums.append(hashlib.sha256(left).hexdigest()), kept.append(left.decode())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "n_words"), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.string()), *([column(batch, "text")] if every else []), *[column(batch, c) for c in others]], names=["id", "n_words", "n_removed", "kept_sha256", "kept", *(["text"] if every else []), *others])

    more = "".join(f", x{i} {kinds[c]}" for i, c in enumerate(names))
    joined = whole.mapInArrow(released(digest), f"id {kinds['doc_id']}, doc_id long, row long, n_words long, whole_sha256 string, text string{more}").join(cut, ["doc_id", "row"], "left")
    out = joined.mapInArrow(released(cover), f"id {kinds['doc_id']}, n_words long, n_removed long, kept_sha256 string, kept string{', text string' if every else ''}{more}")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept", *(["text"] if every else []), *[F.col(f"x{i}").alias(c) for i, c in enumerate(names)])


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
