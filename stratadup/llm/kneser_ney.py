"""An interpolated modified Kneser-Ney trigram model, counted in Spark.

Texts are led by two starts and closed by one end, so that every token has two before it. The
model lies in the cluster's shared folder as sorted hash arrays, one file per array and shard,
which workers map into memory:

* vocabulary shards (ranges of the word hash): hashes, token counts, and per word its
  continuation count and, as a context, its total and how many followers it has once, twice and
  more often. A word's number is its rank over all shards.
* pair shards (ranges of a mixed key): sorted hashes of bigrams; per bigram its continuation
  count and the same facts as a context.
* trigram shards: sorted hashes of trigrams, and counts. A trigram lies in the shard of its last
  two words, so that it is counted and their continuation count is known in one place.

A sorted hash array keeps 32 bits of each hash in buckets of about eight, which are found by the
hash's leading bits. An n-gram that was never seen
is taken for another with a probability of about 8 / 2^32; two seen ones share an entry with
about 4 / 2^32 each.

Counting takes three shuffles of pre-aggregated, compressed blocks: words, trigrams, and sums per
word and pair. Blocks are dealt by hash, so frequent words and contexts spread over all shards;
a shard's size follows the bytes of text per shard. A shard's file is written under another
name and renamed, so a repeated task does no harm.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadup.llm import textkit
from stratadup.llm.durable import durable, mounted_dir
from stratadup.llm.textkit import column, pick, released

END = np.uint64(0x5BD1E995C2B2AE35)  # stands for the end of a text among word hashes
GATHERED = 4_000_000
BLOCK = "shard long, a binary, b binary, c binary"


def held_out(key: Column) -> Column:
    """Documents that the model never counts: the checksum of the id's digits leaves 1 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, an end after each text, and bounds of texts in them."""
    words = textkit.split(texts, lower=True)
    hashes, n = words.hashes(), len(texts)
    bounds = words.bounds + np.arange(n + 1)
    out = np.empty(len(hashes) + n, np.uint64)
    ends = bounds[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = hashes, END
    return out, bounds


def _save(folder: str, name: str, array: np.ndarray) -> None:
    at = f"{folder}/{name}.npy"
    new = f"{folder}/.{name}.{uuid.uuid4().hex}.npy"
    np.save(new, array)
    os.replace(new, at)


_open: dict[str, np.ndarray] = {}


def _load(folder: str, name: str) -> np.ndarray:
    at = f"{folder}/{name}.npy"
    if at not in _open:
        for old in [k for k in _open if not k.startswith(folder)]:
            del _open[old]
        _open[at] = np.load(at, mmap_mode="r")
    return _open[at]


def _summed(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values (or their number)."""
    if values is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)  # sums of whole numbers are the same in any order
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)


def _packed(x: np.ndarray, delta: bool = False) -> bytes:
    """Unsigned integers, compressed byte plane by byte plane; `delta` where they ascend."""
    x = x.astype("<u8")
    if delta:
        x = np.diff(x, prepend=np.uint64(0))
    planes = np.ascontiguousarray(x.view("u1").reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if len(x) else b"")


def _unpacked(block: bytes, delta: bool = False) -> np.ndarray:
    n = int.from_bytes(block[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(block[8:], 8 * n, "zstd", asbytes=True), "u1").reshape(8, n)
    x = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if delta else x


def _joined(table: pa.Table, name: str, delta: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(_unpacked(b, delta) for b in table[name].to_pylist())])


def _blocks(shard: list[int], a: list[bytes], b: list[bytes], c: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names=["shard", "a", "b", "c"])


def _dealt(shard: np.ndarray, ascending: np.ndarray, more: np.ndarray | None, counts: np.ndarray) -> pa.RecordBatch:
    """One block per shard; every shard's part stays in order."""
    order = np.argsort(shard, kind="stable")
    used, first = np.unique(shard[order], return_index=True)
    parts = [order[x:y] for x, y in zip(first, np.append(first[1:], len(order)), strict=True)]
    return _blocks(used.tolist(), [_packed(ascending[p], True) for p in parts], [b"" if more is None else _packed(more[p]) for p in parts], [_packed(counts[p]) for p in parts])


def _save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts in a byte each; those of 255 and more beside them, by place."""
    many = np.flatnonzero(counts >= 255)
    _save(folder, name, np.minimum(counts, 255).astype("u1"))
    _save(folder, f"{name}_many", np.stack([many, counts[many].astype(np.int64)]))


def _counts_at(folder: str, name: str, places: np.ndarray) -> np.ndarray:
    out = _load(folder, name)[places].astype(np.int64)
    many = np.flatnonzero(out == 255)
    if len(many):
        at, counts = _load(folder, f"{name}_many")
        out[many] = counts[np.searchsorted(at, places[many])]
    return out


def _save_hashes(folder: str, name: str, hashes: np.ndarray) -> None:
    """A sorted hash array: bounds of buckets by the leading bits, 32 further bits of each hash."""
    bits = max(len(hashes) // 8, 1).bit_length() - 1
    cut = hashes >> np.uint64(32 - bits)
    edges = np.arange(2**bits + 1, dtype=np.uint64) << np.uint64(32)
    _save(folder, f"{name}_bounds", np.searchsorted(cut, edges).astype(np.int64))
    _save(folder, name, cut.astype("<u4"))


def _places(folder: str, name: str, hashes: np.ndarray) -> np.ndarray:
    """Where the hashes stand in a sorted hash array; -1 for absent ones."""
    if not os.path.exists(f"{folder}/{name}.npy"):
        return np.full(len(hashes), -1, np.int64)
    bounds, known = _load(folder, f"{name}_bounds"), _load(folder, name)
    bits = (len(bounds) - 1).bit_length() - 1
    cut = hashes >> np.uint64(32 - bits)
    bucket, rest = (cut >> np.uint64(32)).astype(np.int64), cut.astype("<u4")
    low, end = bounds[bucket], bounds[bucket + 1]
    high = end
    while (low < high).any():
        mid = (low + high) // 2
        less = (low < high) & (known[np.minimum(mid, len(known) - 1)] < rest)
        low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
    return np.where((low < end) & (known[np.minimum(low, len(known) - 1)] == rest), low, -1) if len(known) else np.full(len(hashes), -1, np.int64)


WORD = np.uint64(32)
LAST = np.uint64(2**32 - 1)
FACTS = ("total", "once", "twice", "more")


def _pair_shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return _shard_of(textkit.mix(pairs, 5), shards).astype(np.int64)


def _pair_hash(pairs: np.ndarray) -> np.ndarray:
    return textkit.mix(pairs, 6)


def _trigram_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return textkit.mix(textkit.mix(before, 7) ^ words, 8)


def _ranges(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every value that occurs, with the places where it does."""
    order = np.argsort(owner, kind="stable")
    used, first = np.unique(owner[order], return_index=True)
    for s, x, y in zip(used.tolist(), first, np.append(first[1:], len(order)), strict=True):
        yield s, order[x:y]


def _classes(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per key number: the sum of its counts, and how many are 1, 2 and more."""
    return np.stack([np.bincount(keys, counts)] + [np.bincount(keys, counts == k) for k in (1, 2)] + [np.bincount(keys, counts >= 3)], 1).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, the vocabulary's shard offsets, totals, and the discounts of trigrams,
    bigrams and words; of the contexts of one and two starts, the total and classes."""

    folder: str
    shards: int
    offsets: tuple[int, ...]
    n_tokens: int
    discounts: tuple[float, ...]
    pair_discounts: tuple[float, ...]
    low_discounts: tuple[float, ...]
    low_total: int
    low_classes: tuple[int, int, int]
    start: tuple[int, int, int, int]
    starts: tuple[int, int, int, int]

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for unknown words. `hashes` is sorted."""
        out = np.full(len(hashes), -1, np.int64)
        edge = np.searchsorted(_shard_of(hashes, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            h = hashes[edge[s] : edge[s + 1]]
            if len(h) and self.offsets[s + 1] > self.offsets[s]:
                known = _load(self.folder, f"word{s}")
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out[edge[s] : edge[s + 1]] = np.where(known[at] == h, at + self.offsets[s], -1)
        return out

    def of_words(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """An array's values for sorted word numbers; 0 for unknown words."""
        out = np.zeros(len(numbers), np.int64)
        edge = np.searchsorted(numbers, self.offsets)
        for s in range(self.shards):
            if edge[s] < edge[s + 1]:
                out[edge[s] : edge[s + 1]] = _load(self.folder, f"{name}{s}")[numbers[edge[s] : edge[s + 1]] - self.offsets[s]]
        return out

    def of_pairs(self, pairs: np.ndarray) -> dict[str, np.ndarray]:
        """Continuation counts and facts of distinct bigrams; 0 for those never seen."""
        out = {name: np.zeros(len(pairs), np.int64) for name in ("cont", *FACTS)}
        for s, at in _ranges(_pair_shard(pairs, self.shards)):
            place = _places(self.folder, f"pair{s}", _pair_hash(pairs[at]))
            at, place = at[place >= 0], place[place >= 0]
            for name, values in out.items():
                if len(at):
                    values[at] = _counts_at(self.folder, f"pair{name}{s}", place)
        return out

    def of_trigrams(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of trigrams; 0 for those never seen."""
        out = np.zeros(len(words), np.int64)
        for s, at in _ranges(_pair_shard((before & LAST) << WORD | words, self.shards)):
            place = _places(self.folder, f"trigram{s}", _trigram_hash(before[at], words[at]))
            at, place = at[place >= 0], place[place >= 0]
            if len(at):
                out[at] = _counts_at(self.folder, f"trigramcount{s}", place)
        return out


def _discounts(t: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items that occur once to four times."""
    if not t[0] or not t[1]:
        return (0.5, 0.75, 0.9)
    y = t[0] / (t[0] + 2 * t[1])
    d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2] if t[2] else 1.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def _gathered(batches: Iterator[pa.RecordBatch], make) -> Iterator[tuple[np.ndarray, ...]]:
    """What `make` gives for texts, joined over up to GATHERED tokens at a time."""
    held, n = [], 0
    for batch in textkit.slices(batches):
        held.append(make(column(batch, "text")))
        n += len(held[-1][0])
        if n >= GATHERED:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _trigrams(before: np.ndarray, words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct contexts, and of the distinct trigrams in order the context's place, last word and count."""
    order = np.argsort(before)  # a search for each would be most of the work
    before = before[order]
    fresh = np.ones(len(before), bool)
    fresh[1:] = before[1:] != before[:-1]
    contexts, keys = before[fresh], np.cumsum(fresh, dtype=np.uint64)
    del before, fresh
    keys -= np.uint64(1)
    keys <<= WORD
    keys |= words[order]
    counts = None if counts is None else counts[order]
    del order
    keys, n = _summed(keys, counts)
    return contexts, (keys >> WORD).astype(np.int64), keys & LAST, n


def train(texts: DataFrame, shard_bytes: int = 16 << 20) -> Model:
    """Count the column `text` and write the model. Null texts count as empty."""
    spark = texts.sparkSession
    folder = f"{mounted_dir(spark)}/kneser_ney_{uuid.uuid4().hex}"
    os.makedirs(folder)
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(8, n_bytes // shard_bytes)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (found,) in _gathered(batches, lambda t: (tokens(t)[0],)):
            keys, n = _summed(found)
            yield _dealt(_shard_of(keys, shards), keys, None, n)

    def word_shard(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, n = _summed(_joined(table, "a", True), _joined(table, "c").astype(np.int64))
        _save(folder, f"word{s}", keys)
        _save(folder, f"count{s}", n)
        return pa.table({"shard": pa.array([s], pa.int64()), "size": pa.array([len(keys)], pa.int64()), "n": pa.array([int(n.sum())], pa.int64())})

    found = texts.mapInArrow(released(words), BLOCK).groupBy("shard").applyInArrow(word_shard, "shard long, size long, n long").collect()
    size = np.zeros(shards, np.int64)
    for r in found:
        size[r["shard"]] = r["size"]
    offsets = tuple(int(x) for x in np.concatenate(([0], np.cumsum(size))))
    n_tokens = sum(r["n"] for r in found)
    if offsets[-1] >= 2**32 - 1:
        raise ValueError("bigram keys hold word numbers of 32 bits")
    nothing = (0, 0, 0, 0)
    model = Model(folder, shards, offsets, n_tokens, (), (), (), 0, (0, 0, 0), nothing, nothing)
    start = offsets[-1]  # the number of the starts before a text's first token
    starts = np.uint64(start) << WORD | np.uint64(start)
    # what sums go to: words by shard, the start, pairs by shard, two starts
    of_start, of_pairs, of_starts, of_orders = shards, shards + 1, 2 * shards + 1, -1

    def numbered(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, bounds = tokens(text)
        distinct, inverse = np.unique(h, return_inverse=True)
        w = model.numbers(distinct)[inverse].astype(np.uint64)
        first, last = np.full(len(w), start, np.uint64), np.full(len(w), start, np.uint64)
        place = np.arange(len(w)) - np.repeat(bounds[:-1], np.diff(bounds))
        last[1:] = np.where(place[1:] > 0, w[:-1], start)
        first[2:] = np.where(place[2:] > 1, w[:-2], start)
        return first << WORD | last, w

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, w in _gathered(batches, numbered):
            contexts, at, w, n = _trigrams(before, w)
            before = contexts[at]
            yield _dealt(_pair_shard((before & LAST) << WORD | w, shards), before, w, n)

    def trigram_shard(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        contexts, at, w, n = _trigrams(_joined(table, "a", True), _joined(table, "b"), _joined(table, "c").astype(np.int64))
        before = contexts[at]
        hashes = _trigram_hash(before, w)
        order = np.argsort(hashes)
        _save_hashes(folder, f"trigram{s}", hashes[order])
        _save_counts(folder, f"trigramcount{s}", n[order])
        pairs, cont = np.unique((before & LAST) << WORD | w, return_counts=True)
        hashes = _pair_hash(pairs)
        order = np.argsort(hashes)
        _save_hashes(folder, f"pair{s}", hashes[order])
        _save_counts(folder, f"paircont{s}", cont[order])
        # sums per word: followers' continuation counts, contexts' totals and classes
        context, follower = (pairs >> WORD).astype(np.int64), (pairs & LAST).astype(np.int64)
        distinct, place = np.unique(context, return_inverse=True)
        word, c = np.unique(follower, return_counts=True)
        numbers = np.concatenate((distinct, word))
        rows = np.zeros((len(numbers), 5), np.int64)
        rows[: len(distinct), 1:] = _classes(place, cont)
        rows[len(distinct) :, 0] = c
        order = np.argsort(numbers, kind="stable")
        numbers, rows = numbers[order], rows[order]
        out: list[tuple[int, bytes, bytes]] = []
        for v, part in _ranges(np.searchsorted(offsets, numbers, "right") - 1):
            out.append((v, _packed(numbers[part], True), _packed(rows[part].T.ravel())))
        # sums per pair as a context
        facts = _classes(at, n)
        for v, part in _ranges(np.where(contexts == starts, of_starts, of_pairs + _pair_shard(contexts, shards))):
            out.append((v, _packed(contexts[part], True), _packed(facts[part].T.ravel())))
        out.append((of_orders, b"", _packed(np.array([(x == k).sum() for x in (n, cont) for k in (1, 2, 3, 4)]))))
        shard, a, b = zip(*out, strict=True)
        return pa.Table.from_batches([_blocks(list(shard), list(a), list(b), [b""] * len(out))])

    def sum_shard(key: tuple, table: pa.Table) -> pa.Table:
        s, blocks = key[0].as_py(), [_unpacked(b).astype(np.int64) for b in table["b"].to_pylist()]
        if s == of_orders:
            facts = sum(blocks).tolist()
        elif s < of_pairs:
            rows, numbers = np.concatenate([b.reshape(5, -1) for b in blocks], 1), _joined(table, "a", True).astype(np.int64)
            first, size = (offsets[s], offsets[s + 1] - offsets[s]) if s < shards else (start, 1)
            sums = [np.bincount(numbers - first, row, size).astype(np.int64) for row in rows]
            if s == of_start:
                facts = [int(x[0]) for x in sums[1:]]
            else:
                for name, x in zip(("cont", *FACTS), sums, strict=True):
                    _save(folder, f"{name}{s}", x.astype("<u4") if not len(x) or x.max() < 2**32 else x)
                facts = [int(sums[0].sum())] + [int((sums[0] == k).sum()) for k in (1, 2, 3, 4)] + [int((sums[0] >= 3).sum())]
        else:
            rows, contexts = np.concatenate([b.reshape(4, -1) for b in blocks], 1), _joined(table, "a", True)
            facts = rows.sum(1).tolist()
            if s < of_starts:
                name = f"pair{s - of_pairs}"
                place, size = _places(folder, name, _pair_hash(contexts)), len(_load(folder, name))
                for fact, row in zip(FACTS, rows, strict=True):
                    _save_counts(folder, f"pair{fact}{s - of_pairs}", np.bincount(place, row, size).astype(np.int64))
                facts = []
        return pa.table({"shard": pa.array([s], pa.int64()), "facts": pa.array([facts], pa.list_(pa.int64()))})

    blocks = texts.mapInArrow(released(trigrams), BLOCK).groupBy("shard").applyInArrow(trigram_shard, BLOCK)
    facts = blocks.groupBy("shard").applyInArrow(sum_shard, "shard long, facts array<long>").collect()
    orders, begin, begins, low = [0] * 8, nothing, nothing, [0] * 6
    for r in facts:
        if r["shard"] == of_orders:
            orders = r["facts"]
        elif r["shard"] == of_start:
            begin = tuple(r["facts"])
        elif r["shard"] == of_starts:
            begins = tuple(r["facts"])
        elif r["shard"] < shards:
            low = [a + b for a, b in zip(low, r["facts"], strict=True)]
    return Model(folder, shards, offsets, n_tokens, _discounts(orders[:4]), _discounts(orders[4:]), _discounts(low[1:5]), low[0], (low[1], low[2], low[5]), begin, begins)


def _discounted(count: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0)


def _interpolated(count: np.ndarray, context: dict[str, np.ndarray], d: tuple[float, ...], lower: np.ndarray) -> np.ndarray:
    """Discounted shares of the contexts' totals, the rest dealt by the lower order."""
    if not d:
        return lower
    rest = sum(x * context[name] for x, name in zip(d, FACTS[1:], strict=True))
    total = np.maximum(context["total"], 1)
    return np.where(context["total"] > 0, _discounted(count, d) / total + rest / total * lower, lower)


def log_probabilities(model: Model, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: log10 of the model's and of the smoothed unigram's probability, and whether it is known."""
    distinct, inverse = np.unique(h, return_inverse=True)
    number = model.numbers(distinct)
    by = np.argsort(number, kind="stable")
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    fact = {name: model.of_words(name, number[by])[back] for name in ("count", "cont", "total", "once", "twice", "more")}
    size = model.size
    base = np.log10((fact["count"] + 0.5) / (model.n_tokens + 0.5 * (size + 1)))
    low = np.full(len(distinct), 1.0 / (size + 1))
    if model.low_total:
        gamma = sum(d * n for d, n in zip(model.low_discounts, model.low_classes, strict=True)) / model.low_total
        low = _discounted(fact["cont"], model.low_discounts) / model.low_total + gamma / (size + 1)
    # bigrams of a known word or start and a known word
    w, first = number[inverse], bounds[:-1]
    before = np.empty_like(inverse)
    before[1:] = inverse[:-1]
    before[first] = len(distinct)  # the start's row
    last = np.append(number, size)[before]
    known = (last >= 0) & (w >= 0)
    keys = last[known].astype(np.uint64) << WORD | w[known].astype(np.uint64)
    pairs, at = np.unique(keys, return_inverse=True)
    pair = np.full(len(h), len(pairs), np.int64)  # unknown ones have a row of zeros
    pair[known] = at
    of_pair = {name: np.append(x, 0) for name, x in model.of_pairs(pairs).items()}
    context = {name: np.append(fact[name], b) for name, b in zip(FACTS, model.start, strict=True)}
    p = _interpolated(of_pair["cont"][pair], {name: x[before] for name, x in context.items()}, model.pair_discounts, low[inverse])
    # trigrams whose first two words were seen as a context
    outer = np.empty_like(pair)
    outer[1:] = pair[:-1]
    outer[first] = len(pairs) + 1  # the row of two starts
    context = {name: np.append(of_pair[name], b)[outer] for name, b in zip(FACTS, model.starts, strict=True)}
    seen = np.flatnonzero((context["total"] > 0) & (w >= 0))
    keys = np.append(pairs, np.array([0, size << 32 | size], np.uint64))[outer[seen]]
    count = np.zeros(len(h), np.int64)
    count[seen] = model.of_trigrams(keys, w[seen].astype(np.uint64))
    p = _interpolated(count, context, model.discounts, p)
    return np.log10(p), base[inverse], fact["count"][inverse] > 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of every whole text; other columns than the id are dropped."""
    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches):
            h, bounds = tokens(column(batch, "text"))
            p, base, known = log_probabilities(model, h, bounds)
            n, first = np.diff(bounds), bounds[:-1]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.full(len(n), model.n_tokens, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(p, first))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(released(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(docs: DataFrame) -> DataFrame:
    """Count the documents that are not held out, score all, and give perplexities too.

    Null texts count as empty: one end. Rows that repeat an id are texts of their own; a null id is
    not held out. Texts are scored whole, equal ones alike. Further columns are ignored, whatever
    their names. An empty table gives an empty result. The
    scores are written to the shared folder before the model is deleted.
    """
    docs = pick(docs, "doc_id", "text")
    texts = docs.where(~held_out(docs["doc_id"])).select(docs["text"].cast("string").alias("text"))
    model = train(texts)
    try:
        return durable(score(docs, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
    finally:
        shutil.rmtree(model.folder, ignore_errors=True)
