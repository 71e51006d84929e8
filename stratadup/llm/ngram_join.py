"""Similarity join of documents on the Jaccard coefficient of their word n-gram sets.

Vertical partitioning: n-grams are hashed, and the order of hashes is cut into fragments. Each
document's set falls into segments, one per fragment, and every fragment counts by itself; the
sums over fragments give exact overlaps.

1. Each fragment counts, per document, the n-grams that any other document has. A document
   whose sum is below the threshold's share of its set cannot link with anything and leaves.
2. Documents with equal sets form a class, represented by its least id.
3. Representatives order their shared n-grams by frequency, rare ones first. Two sets that link
   share an n-gram among the first of both (prefix filter), and enough of both sets follows the
   first shared one (position filter).
4. Candidate pairs are verified by partial overlaps per fragment, summed per pair.

Groups of near copies are not expanded into all pairs. Each n-gram's documents first meet one
hub, chosen anew by hash in every round; what links becomes one component, and pairs inside a
component need no test. Rounds go on while they thin out the pairs between components; when few
are left, or no longer get fewer, all of them are tested, so no link between components is lost.

N-grams are told apart by 64-bit hashes: two of m different ones are taken for one with a
probability of about m * m / 2**65, which could make one pair's overlap too large by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadup.llm import textkit
from stratadup.llm.components import components
from stratadup.llm.durable import Scratch, durable, relieve
from stratadup.llm.substring_dedup import BitArrays, _id_cells
from stratadup.llm.textkit import column, pick, released, signed

HELD = 1 << 20  # hashes that a task gathers before it deals them out
MAX_BITS = 1 << 28


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and bounds of texts in them.

    A text of fewer words is one n-gram as a whole; a text without words has none.
    """
    words = textkit.split(texts, lower=True)
    h, n = words.hashes(), words.counts()
    hashes, doc, _ = textkit.windows(h, words.bounds, size)
    for short in range(1, size):
        some = np.flatnonzero(n == short)
        if len(some):
            at = words.bounds[:-1][some]
            whole = np.zeros(len(some), np.uint64)
            for j in range(short):
                whole = textkit.mix(whole + h[at + j], 30 + j)
            hashes, doc = np.concatenate((hashes, textkit.mix(whole, 20 + short))), np.concatenate((doc, some))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """The number of the range that holds each hash, of equal ranges in hash order."""
    return ((hashes >> np.uint64(40)) * np.uint64(fragments)) >> np.uint64(24)


def shared_counts(rows: DataFrame, size: int, fragments: int) -> DataFrame:
    """Rows (doc_id, n, shared): the set's size, and how many of its n-grams occur elsewhere.

    What several documents of a task's gathered hashes share is counted there, and goes on as a
    bare hash; so a frequent n-gram reaches its fragment once for HELD hashes, not once per
    document. Rows that repeat an id count for each other. A bucket is a range of hashed ids;
    totals of documents pass the fragments by, as fragments with negative numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in textkit.slices(batches):
            hashes, bounds = shingle_sets(column(batch, "text"), size)
            held.append((hashes, np.diff(bounds), column(batch, "doc_id").to_numpy().astype(np.int64)))
            total += len(hashes)
            if total >= HELD:
                yield deal(held)
                held, total = [], 0
        if held:
            yield deal(held)

    def deal(held: list) -> pa.RecordBatch:
        hashes, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), n)
        order = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[order], doc[order]
        known = _in_runs(hashes)
        inside = np.bincount(doc[known], minlength=len(ids))
        out: list[list] = [[] for _ in SEGMENT]

        def put(*values) -> None:
            for c, v in zip(out, values, strict=True):
                c.append(v)

        for bucket, at in _buckets(ids, fragments):
            put(-1 - bucket, ids[at].tobytes(), n[at].astype("<i4").tobytes(), inside[at].astype("<i4").tobytes(), b"")
        marks, single, doc = np.unique(hashes[known]), hashes[~known], doc[~known]
        edge, marked = (np.searchsorted(fragment_of(h, fragments), np.arange(fragments + 1)) for h in (single, marks))
        for f in range(fragments):
            h, d, m = single[edge[f] : edge[f + 1]], doc[edge[f] : edge[f + 1]], marks[marked[f] : marked[f + 1]]
            if len(h) or len(m):
                by = np.argsort(d, kind="stable")
                d = d[by]
                head = np.flatnonzero(np.diff(d, prepend=-1))
                put(f, ids[d[head]].tobytes(), np.diff(head, append=len(d)).astype("<i4").tobytes(), h[by].tobytes(), m.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32())] + [pa.array(c, pa.binary()) for c in out[1:]], names=SEGMENT)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        ids, n = _joined(table, "ids", "<i8"), _joined(table, "n", "<i4")
        f = key[0].as_py()
        if f < 0:
            return _summed_block(-1 - f, ids, n, _joined(table, "hashes", "<i4"))
        single, marks = _joined(table, "hashes", "<u8"), _joined(table, "marks", "<u8")
        h = np.concatenate((single, marks))
        order = np.argsort(h, kind="stable")
        found = np.empty(len(h), bool)
        found[order] = _in_runs(h[order])
        found = np.concatenate(([0], np.cumsum(found[: len(single)])))
        end = np.cumsum(n)
        shared = found[end] - found[end - n]
        some = shared > 0  # a document has no row where nothing is shared
        ids, shared = ids[some], shared[some]
        blocks = [_summed_block(bucket, ids[at], np.zeros(len(at), np.int64), shared[at]) for bucket, at in _buckets(ids, fragments)]
        return pa.concat_tables(blocks) if blocks else _summed_block(0, *[np.zeros(0, np.int64)] * 3)

    def add(table: pa.Table) -> pa.Table:
        doc, inverse = np.unique(_joined(table, "ids", "<i8"), return_inverse=True)
        sums = [np.bincount(inverse, _joined(table, name, "<i4"), len(doc)).astype(np.int64) for name in ("n", "shared")]
        return pa.table({"doc_id": pa.array(doc), "n": pa.array(sums[0]), "shared": pa.array(sums[1])})

    cuts = rows.mapInArrow(released(cut), "fragment int, ids binary, n binary, hashes binary, marks binary")
    found = cuts.groupBy("fragment").applyInArrow(count, "bucket int, ids binary, n binary, shared binary")
    return found.groupBy("bucket").applyInArrow(add, "doc_id long, n long, shared long")


SEGMENT = ["fragment", "ids", "n", "hashes", "marks"]


def _buckets(ids: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers, and the places of the ids that fall into them."""
    bucket = (_id_cells(ids) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    head = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(ids)], strict=True) if len(ids) else ():
        yield int(bucket[order[a]]), order[a:b]


def _summed_block(bucket: int, ids: np.ndarray, n: np.ndarray, shared: np.ndarray) -> pa.Table:
    block = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "ids": block(ids, "<i8"), "n": block(n, "<i4"), "shared": block(shared, "<i4")})


def _in_runs(ordered: np.ndarray) -> np.ndarray:
    """Which values of an ordered array have an equal neighbour."""
    same = np.zeros(len(ordered) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    return same[:-1] | same[1:]


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def frequencies(sets: DataFrame, fragments: int) -> DataFrame:
    """Rows (h, df) of the n-grams that several of the sets (doc_id, hashes) have.

    Hashes travel in binary blocks per fragment, distinct and counted within each slice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                h, c = np.unique(column(batch, "hashes").slice(at, 2000).flatten().to_numpy().view(np.uint64), return_counts=True)
                edge = np.searchsorted(fragment_of(h, fragments), np.arange(fragments + 1))
                used = [f for f in range(fragments) if edge[f] < edge[f + 1]]
                parts = [slice(edge[f], edge[f + 1]) for f in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([h[p].tobytes() for p in parts], pa.binary()), pa.array([c[p].astype("<i4").tobytes() for p in parts], pa.binary())], names=["fragment", "hashes", "counts"])

    def count(table: pa.Table) -> pa.Table:
        h, c = _joined(table, "hashes", "<u8"), _joined(table, "counts", "<i4").astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.add.reduceat(c, first)
        return pa.table({"h": pa.array(signed(h[first][total > 1])), "df": pa.array(total[total > 1])})

    cuts = sets.mapInArrow(released(cut), "fragment int, hashes binary, counts binary")
    return cuts.groupBy("fragment").applyInArrow(count, "h long, df long")


def _sets_of(rows: DataFrame, survivors: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, hashes) of the survivors, and of few others that the bit array lets pass."""

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_id_cells(batch.column(0).to_numpy()).astype(np.int64))], names=["cell"])

    cells = survivors.select("doc_id").mapInArrow(cell_of, "cell long")
    marked = rows.sparkSession.sparkContext.broadcast(BitArrays.collect(cells, 1, MAX_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked.value.has(0, _id_cells(column(batch, "doc_id").to_numpy()))))
            for part in textkit.slices([batch]):
                hashes, bounds = shingle_sets(column(part, "text"), size)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(signed(hashes)))], names=["doc_id", "hashes"])

    return rows.mapInArrow(released(run), "doc_id long, hashes array<long>")


def _signatures(sets: DataFrame) -> DataFrame:
    """Rows (doc_id, a, b): 128 bits that equal sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            h = lists.flatten().to_numpy().view(np.uint64)
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            out = []
            for seed in (41, 42):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textkit.mix(h, seed), dtype=np.uint64)))
                out.append(pa.array(signed(textkit.mix(total[at[1:]] - total[at[:-1]], seed))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["doc_id", "a", "b"])

    return sets.mapInArrow(released(run), "doc_id long, a long, b long")


def _enough(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (a + b)


def _verify(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose partial overlaps, counted per fragment, sum to enough."""
    left = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("part").alias("pa"))
    right = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("part").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(_enough(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def link(docs: DataFrame, size: int = 5, percent: int = 80, fragment_bytes: int = 10 << 20, rounds: int = 6, verify_fragments: int = 4) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per document id.

    Two documents link when percent/100 of their sets' union is shared; a component is named by
    its least id. Null texts and texts without words have empty sets and link with nothing, long
    texts count whole. Rows with equal ids are one document, whose set is that of all its rows.
    Rows with a null id are counted each for itself, link with nothing and have no component.
    Further columns of the table are ignored, whatever their names.
    """
    docs = pick(docs, "doc_id", "text")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    nameless = _sizes(docs.where("doc_id is null"), size)
    linked = _link(docs.where("doc_id is not null"), size, percent, fragment_bytes, rounds, verify_fragments)
    return linked.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches):
            n = np.diff(shingle_sets(column(batch, "text"), size)[1])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n.astype(np.int64))], names=["doc_id", "n_shingles"])

    return rows.mapInArrow(released(run), "doc_id long, n_shingles long")


def _link(rows: DataFrame, *parameters: int) -> DataFrame:
    scratch = Scratch(rows.sparkSession)
    try:  # the result reads checkpoints only
        return _link_in(scratch, rows, *parameters)
    finally:
        scratch.clear()


def _link_in(scratch: Scratch, rows: DataFrame, size: int, percent: int, fragment_bytes: int, rounds: int, verify_fragments: int) -> DataFrame:
    from pyspark.sql import Window

    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    fragments = max(8, n_bytes // fragment_bytes)
    counts = durable(shared_counts(rows, size, fragments))
    survivors = counts.where(100 * F.col("shared") >= percent * F.col("n")).select("doc_id")
    repeated = durable(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    any_repeated = bool(repeated.limit(1).count())

    sets = _sets_of(rows, survivors.unionByName(repeated), size)
    if any_repeated:
        pooled = sets.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))
        sets = scratch.keep(pooled.where(F.size("hashes") > 0))
        exact = sets.select("doc_id", F.size("hashes").cast("long").alias("pooled"))
        counts = durable(counts.join(exact, "doc_id", "left").select("doc_id", F.coalesce("pooled", "n").alias("n")))
    else:
        sets = scratch.keep(sets.where(F.size("hashes") > 0))
    signed_sets = durable(_signatures(sets))
    classes = signed_sets.groupBy("a", "b").agg(F.min("doc_id").alias("rep"))
    member = durable(signed_sets.join(classes, ["a", "b"]).select("doc_id", "rep"))

    reps = scratch.keep(sets.join(member.where("doc_id = rep").select("doc_id"), "doc_id"))
    common = frequencies(reps, max(8, fragments // 4))
    grams = reps.select("doc_id", F.size("hashes").cast("int").alias("n"), F.explode("hashes").alias("h"))
    shared = grams.join(common, "h")
    by_doc = Window.partitionBy("doc_id")
    ranked = shared.withColumn("k", F.row_number().over(by_doc.orderBy("df", "h"))).withColumn("matched", F.count("*").over(by_doc))
    # n-grams of no other document come first in the order
    ranked = ranked.where(100 * F.col("matched") >= percent * F.col("n")).withColumn("place", (F.col("n") - F.col("matched") + F.col("k") - 1).cast("int"))
    ranked = scratch.keep(ranked.select("doc_id", "n", "h", "place"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    lists = ranked.where(F.col("place") < prefix).select("h", "doc_id", "n", "place")
    lists = scratch.keep(lists.join(lists.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "h"))
    fragment = F.pmod(F.shiftright("h", 40), F.lit(verify_fragments)).cast("int")
    segments = scratch.keep(ranked.join(lists.select("doc_id").distinct(), "doc_id").groupBy("doc_id", fragment.alias("fragment")).agg(F.collect_list("h").alias("part")))

    labels = durable(lists.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("label")))
    step, before = 0, None
    while labels.limit(1).count():
        relieve(lists.sparkSession)
        current, last = lists.join(labels, "doc_id"), rounds == 0
        if step:
            sizes = current.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q")).where("m * m > q")
            left = sizes.agg(F.sum((F.col("m").cast("double") * F.col("m") - F.col("q")) / 2)).first()[0]
            if not left:
                break
            current = current.join(sizes.select("h"), "h")
            last = last or left <= 20 * n_rows or (step >= rounds and left > 0.8 * before)
            before = left
        pairs = _all_pairs(current, percent) if last else _hub_pairs(current, percent, step)
        found = _verify(pairs, segments, percent)
        # links between components, not documents: what is linked already needs no second look
        ends = found.join(labels.select(F.col("doc_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("doc_id").alias("b"), F.col("label").alias("lb")), "b")
        merged = components(ends, "la", "lb")
        labels = durable(labels.join(merged, F.col("label") == F.col("node"), "left").select("doc_id", F.coalesce("component", "label").alias("label")))
        step += 1
        if last:
            break
    of_member = member.join(labels.select(F.col("doc_id").alias("rep"), "label"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("component_id"))
    ids = rows.select("doc_id").distinct()
    out = ids.join(counts.select("doc_id", "n"), "doc_id", "left").join(of_member, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _near_enough(percent: int) -> Column:
    rest = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return _enough(rest, F.col("na"), F.col("nb"), percent)


def _hub_pairs(current: DataFrame, percent: int, step: int) -> DataFrame:
    """Each n-gram's documents beside its hub, where both lie in different components."""
    draw = F.xxhash64(F.col("doc_id"), F.lit(step)) if step else F.col("doc_id")
    hub = current.groupBy("h").agg(F.min(F.struct(draw.alias("draw"), "doc_id", "n", "place", "label")).alias("hub"))
    joined = current.join(hub, "h").where("label != hub.label")
    pairs = joined.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), F.col("hub.place").alias("ia"), F.col("place").alias("ib"))
    return pairs.where(_near_enough(percent)).select("a", "b", "na", "nb").distinct()


def _all_pairs(current: DataFrame, percent: int) -> DataFrame:
    """All pairs of documents in different components that share an n-gram of both prefixes."""
    x = current.select("h", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("ia"), F.col("label").alias("la"))
    y = current.select("h", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("ib"), F.col("label").alias("lb"))
    pairs = x.join(y, "h").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))).where(_near_enough(percent))
    return pairs.select("a", "b", "na", "nb").distinct()
