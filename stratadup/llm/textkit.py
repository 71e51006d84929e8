"""Vectorised word hashing over Arrow string buffers, shared by the n-gram operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These bytes never occur
inside a multi-byte UTF-8 character, so words are found on the raw buffer. A word's hash is
a polynomial over random per-byte values modulo 2**64, taken from prefix sums, then mixed.
All constants come from a fixed seed: every worker computes the same hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 2 << 20
STRIDE = 1 << 12  # powers are products of two short tables, which do not grow with the texts
BLOCK_BYTES = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_tables: dict[tuple[int, bool], np.ndarray] = {}


def _byte_values(seed: int, lower: bool) -> np.ndarray:
    if (seed, lower) not in _tables:
        v = np.random.RandomState(1000 + seed).randint(1, 2**63, 256, dtype=np.uint64) | _U(1)
        if lower:
            v[65:91] = v[97:123]
        _tables[seed, lower] = v
    return _tables[seed, lower]


def _series(base: int, n: int) -> np.ndarray:
    t = np.full(max(n, 1), base % 2**64, _U)
    t[0] = 1
    return np.cumprod(t, dtype=_U)


class Powers:
    """Powers of an odd base modulo 2**64, up to a largest exponent."""

    def __init__(self, base: int, largest: int):
        self.low = _series(base, STRIDE)
        self.high = _series(pow(base, STRIDE, 2**64), largest // STRIDE + 1)

    def at(self, exponents: np.ndarray) -> np.ndarray:
        return self.low[exponents % STRIDE] * self.high[exponents // STRIDE]

    def run(self, start: int, end: int) -> np.ndarray:
        """The powers from `start`, a multiple of the stride, to before `end`."""
        return (self.high[start // STRIDE : -(-end // STRIDE), None] * self.low).ravel()[: end - start]


def _span_sums(values, n: int, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """For every span, the sum of value times base**(place in the span), modulo 2**64.

    `values(a, b)` gives the values of the places a to b. Prefix sums are made block by block
    and kept at the spans' ends only, so that little more than a span's result is held.
    """
    base = int(np.random.RandomState(2000 + seed).randint(1, 2**62)) * 8 + 5
    up, down = Powers(base, n), Powers(pow(base, -1, 2**64), n)
    out, total = np.zeros(len(starts), _U), _U(0)
    for a in range(0, n, BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, n)
        sums = np.empty(b - a + 1, _U)
        sums[0] = total
        np.cumsum(values(a, b) * up.run(a, b), out=sums[1:])
        sums[1:] += total
        total = sums[-1]
        last = b == n
        x, y = np.searchsorted(starts, (a, b + last))
        out[x:y] -= sums[starts[x:y] - a]
        x, y = np.searchsorted(ends, (a, b + last))
        out[x:y] += sums[ends[x:y] - a]
    return out * down.at(starts)


def span_counts(flags, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the places of every span are flagged; `flags(a, b)` tells for the places a to b."""
    out, total = np.zeros(len(starts), np.int64), 0
    for a in range(0, n, BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, n)
        sums = np.concatenate(([0], np.cumsum(flags(a, b), dtype=np.int64))) + total
        total = sums[-1]
        for at, sign in ((starts, -1), (ends, 1)):
            x, y = np.searchsorted(at, (a, b + (b == n)))
            out[x:y] += sign * sums[at[x:y] - a]
    return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ _U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@dataclass
class Words:
    """Words of consecutive texts: bounds[i]:bounds[i+1] are the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    lower: bool

    def hashes(self, seed: int = 0) -> np.ndarray:
        table = _byte_values(seed, self.lower)
        return mix(_span_sums(lambda a, b: table[self.data[a:b]], len(self.data), self.starts, self.ends, seed), seed)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of all texts of an array; null texts have none."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    space = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[1:] = True, space
    starts = np.flatnonzero(~space & (edge[:-1] | first[:-1]))
    after = np.empty(len(raw) + 1, bool)
    after[-1], after[:-1] = True, space
    ends = np.flatnonzero(~space & (after[1:] | first[1:])) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, at), lower)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds `limit` bytes of text at most, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.concatenate(([0], np.cumsum(sizes))), 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word (counted inside its text) of every window of `size` words."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = bounds[:-1][doc] + inside
    if size <= 8:
        out = np.zeros(len(at), _U)
        for j in range(size):
            out = out * _U(0x9E3779B97F4A7C15) + hashes[at + j]
            out ^= out >> _U(29)
    else:
        out = _span_sums(lambda a, b: hashes[a:b], len(hashes), at, at + size, 100 + seed)
    return mix(out, 50 + seed), doc, inside


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Memo(dict):
    """A dictionary that computes what it lacks and keeps `limit` bytes of results at most.

    `size` estimates an entry's bytes; long keys are never kept.
    """

    def __init__(self, make, limit: int, size=lambda key, value: 160 + 2 * len(key), longest: int = 100):
        super().__init__()
        self.make, self.left, self.size, self.longest = make, limit, size, longest

    def __missing__(self, key):
        value = self.make(key)
        if self.left > 0 and len(key) <= self.longest:
            self.left -= self.size(key, value)
            self[key] = value
        return value


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone. A column of exactly that name is meant, whatever other columns
    are called; without one, the first whose name differs in case."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def place(name: str) -> int:
        for same in (str, str.lower):
            at = [i for i, c in enumerate(df.columns) if same(c) == same(name)]
            if at:
                return at[0]
        raise ValueError(f"no column {name}")

    return flat.select(*[flat[f"c{place(n)}"].alias(n) for n in names])


def released(run):
    """The Arrow map `run`, which gives its worker's free memory back when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
