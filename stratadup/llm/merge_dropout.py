"""SentencePiece merging with seeded dropout, and its lossless inverse.

An agenda holds adjacent symbols whose union is a piece, best score first, leftmost on a tie.
Every candidate taken from the agenda is skipped with the dropout rate. Draws are keyed by
(seed, document id, place of the chunk in the text), so every occurrence of a word is segmented
for itself and the same seed gives the same pieces on any worker. A draw tells how many
candidates pass before the next one is skipped. With no dropout the pieces are the library's.

White space becomes the mark U+2581; a mark that is in the text itself is written in bytes, so
that decoding restores every text. Texts are cut into chunks between characters that stand side
by side in no piece, so no merge crosses a cut. The agendas of many chunks are worked off together:
in each step every chunk takes its best candidate, draws, and merges or skips it, as operations
on whole arrays. Chunks wider than the arrays have a heap each, with the same results. Nothing is
remembered from text to text, so cost and memory do not depend on which words were met before.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratadup.llm.textkit import column, mix, pick, released, slices

MARK = "▁"
WIDEST = 64  # symbols of a chunk that shares arrays with others
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, WIDEST)
BLOCK = 1 << 19  # characters that are encoded together
NO_POINT = 0x110000  # stands for a mark that is in the text itself
_NEVER = 1 << 30
_MASK = 2**64 - 1
_U = np.uint64


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 0


class Pairs:
    """What pairs of symbols give, -1 if nothing: a table with open addresses, asked by arrays."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, found: dict[tuple[int, int], int]):
        bits = max(8, (8 * len(found)).bit_length())
        self.shift, self.last = 64 - bits, 2**bits - 1
        self.keys, self.values = np.full(2**bits, -1, np.int64), np.full(2**bits, -1, np.int32)
        for (a, b), value in found.items():
            key = a << 32 | b
            i = (key * self.FACTOR & _MASK) >> self.shift
            while self.keys[i] != -1:
                i = (i + 1) & self.last
            self.keys[i], self.values[i] = key, value

    def at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        home = (key.view(_U) * _U(self.FACTOR) >> _U(self.shift)).view(np.int64)
        held = self.keys[home]
        out = np.where(held == key, self.values[home], np.int32(-1))
        rest = np.flatnonzero((held != key) & (held != -1))
        while len(rest):
            home[rest] = (home[rest] + 1) & self.last
            held = self.keys[home[rest]]
            same = held == key[rest]
            out[rest[same]] = self.values[home[rest[same]]]
            rest = rest[~same & (held != -1)]
        return out


class Codec:
    """Encodes texts to ids and decodes them, for a byte-fallback BPE model."""

    def __init__(self, path: str, dropout: Dropout, widest: int = WIDEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        n = model.vocab_size()
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special(i)}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte_ids) < 256 or MARK not in self.ids:
            raise ValueError("lossless decoding needs a model with byte fallback and a mark")
        self.raw = [b""] * n
        for p, i in self.ids.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.fallback = np.array([self.byte_ids[b] for b in range(256)])
        # symbols are pieces, characters of pieces, and one for all that is in no piece
        self.symbol = {p: i for i, p in enumerate(dict.fromkeys([*self.ids, *(c for p in self.ids for c in p)]))}
        self.other = len(self.symbol)
        self.id_of = np.array([*(self.ids.get(p, -1) for p in self.symbol), -1])
        self.of_point = np.full(NO_POINT + 1, self.other, np.int32)
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.of_point[ord(p)] = i
        ranks = {score: i for i, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        # where a pair stands in the agenda, to which its place is added; the last entry serves -1
        self.order = np.array([*(ranks[self.scores[p]] * WIDEST if p in self.scores else _NEVER for p in self.symbol), _NEVER], np.int32)
        halves = {(self.symbol[p[:i]], self.symbol[p[i:]]): self.symbol[p] for p in self.ids for i in range(1, len(p)) if p[:i] in self.symbol and p[i:] in self.symbol}
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs = Pairs(halves)
        self.first = Pairs({(a, b): halves.get((a, b), self.other) for a, b in ((self.symbol[x], self.symbol[y]) for x, y in self.beside)})
        self.dropout, self.widest = dropout, min(widest, WIDEST)
        self.seed = int.from_bytes(hashlib.blake2b(f"{dropout.seed}".encode(), digest_size=8).digest(), "little")
        # entry m - 1 from behind: draws below it, of 2**53, let m candidates or more pass
        self.passing = [int((1 - dropout.rate) ** m * 2**53) for m in range(int(37 / dropout.rate) + 1, 0, -1)] if dropout.rate else []
        self.table = np.array(self.passing, _U)

    def key(self, doc_id) -> int:
        """What a document's draws are keyed by."""
        return int.from_bytes(hashlib.blake2b(f"{doc_id}".encode(), digest_size=8).digest(), "little")

    def _next(self, draw: int, k: int) -> int:
        """Candidates that pass after the k-th skip, before the next one."""
        h = ((draw ^ (k * 0x9E3779B97F4A7C15)) * 0xFF51AFD7ED558CCD) & _MASK
        h = ((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53) & _MASK
        return len(self.passing) - bisect_right(self.passing, (h ^ (h >> 33)) >> 11)

    def _passes(self, draws: np.ndarray) -> np.ndarray:
        return len(self.passing) - np.searchsorted(self.table, draws >> _U(11), "right")

    def _nexts(self, draws: np.ndarray, k: np.ndarray) -> np.ndarray:
        """`_next` for arrays."""
        h = (draws ^ (k.astype(_U) * _U(0x9E3779B97F4A7C15))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return self._passes(h ^ (h >> _U(33)))

    def _skips(self, at: int, draw: int) -> Iterator[int]:
        k = 0
        while True:
            yield at
            k += 1
            at += 1 + self._next(draw, k)

    def segment(self, symbols: list[str], skips: Iterator[int]) -> tuple[list[str], int]:
        """Merge symbols by the agenda; `symbols` are single characters. `skips` are rising numbers
        of candidates to skip, -1 at the end. Gives the pieces and the number of candidates met."""
        scores, n, met, skip = self.scores, len(symbols), 0, next(skips)
        symbols = list(symbols)
        size = [1] * n  # characters in the symbol that begins here; 0 where none begins
        before = list(range(-1, n - 1))
        find, push = scores.get, heapq.heappush
        pieces = [x + y for x, y in zip(symbols, symbols[1:], strict=False)]
        agenda = [(-score, i, 2, p) for i, p in enumerate(pieces) if (score := find(p)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, length, piece = heapq.heappop(agenda)
            j = i + size[i]
            if j == i or j >= n or size[i] + size[j] != length:
                continue  # a place and a length name one piece of the text
            met += 1
            if met - 1 == skip:
                skip = next(skips)
                continue
            symbols[i] = piece
            size[i], size[j] = length, 0
            end = i + length
            if end < n:
                before[end] = i
                if (score := find(p := piece + symbols[end])) is not None:
                    push(agenda, (-score, i, length + size[end], p))
            left = before[i]
            if left >= 0 and (score := find(p := symbols[left] + piece)) is not None:
                push(agenda, (-score, left, size[left] + length, p))
        return [symbols[i] for i in range(n) if size[i]], met

    def _together(self, out: np.ndarray, pair: np.ndarray, starts: np.ndarray, sizes: np.ndarray, draws: np.ndarray, skip: np.ndarray, width: int) -> None:
        """Merge the symbols of all chunks, `width` at most in each. `out` holds the characters'
        symbols and gets the merged ones, -1 where none begins; `skip` is each chunk's first skip.

        Arrays have a row per place and a column per chunk; a last row stands for no neighbour.
        """
        rows = np.arange(width)[:, None]
        held = rows < sizes
        at = np.where(held, starts + rows, 0)
        n, none = len(starts), np.full((1, len(starts)), self.other, np.int32)
        symbols = np.concatenate((np.where(held, out[at], np.int32(self.other)), none))
        union = np.concatenate((np.where(rows < sizes - 1, pair[at], np.int32(-1)), none))
        agenda = self.order[union]
        agenda[:-1] += rows.astype(np.int32)
        after = np.repeat(np.arange(1, width + 2, dtype=np.int32)[:, None], n, 1)
        before = np.repeat(np.array([width, *range(width)], np.int32)[:, None], n, 1)
        met, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
        while n:
            best = agenda.min(0)
            go = np.flatnonzero(best < _NEVER)
            if 5 * len(go) < 4 * n:
                done = best >= _NEVER
                place, col = np.nonzero(np.arange(width)[:, None] < np.where(done, sizes, 0))
                out[starts[col] + place] = symbols[place, col]
                symbols, union, agenda, after, before = (x.take(go, 1) for x in (symbols, union, agenda, after, before))
                starts, sizes, draws, skip, met, k, best = (x[go] for x in (starts, sizes, draws, skip, met, k, best))
                n = len(go)
                go = np.arange(n)
            s, u, g, a, b = (x.reshape(-1) for x in (symbols, union, agenda, after, before))
            p = best[go] % WIDEST
            g[p * np.int64(n) + go] = _NEVER
            skipped = met[go] == skip[go]
            met[go] += 1
            if skipped.any():
                over = go[skipped]
                k[over] += 1
                skip[over] += 1 + self._nexts(draws[over], k[over])
                go, p = go[~skipped], p[~skipped]
            here = p * np.int64(n) + go
            gone = a[here] * np.int64(n) + go
            new, end = u[here], a[gone]
            s[here], s[gone], g[gone] = new, -1, _NEVER
            a[here], b[end * np.int64(n) + go] = end, p
            u[here] = found = self.pairs.at(new, s[end * np.int64(n) + go])
            g[here] = self.order[found] + p
            left = b[here]
            at = left * np.int64(n) + go
            u[at] = found = self.pairs.at(s[at], new)
            g[at] = self.order[found] + left

    def _run(self, parts: list[str], keys: list[int], places: list[int]) -> tuple[list[bytes], np.ndarray]:
        """The ids of texts that are not empty, and how many chunks each has; `places` counts the
        chunks that stand before in the same document."""
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        out = self.of_point[np.where(points == 32, ord(MARK), np.where(points == ord(MARK), NO_POINT, points))]
        pair = np.append(self.first.at(out[:-1], out[1:]), np.int32(-1))
        pair[bounds[1:] - 1] = -1
        starts = np.flatnonzero(np.append(True, pair[:-1] < 0))
        sizes = np.diff(starts, append=len(points))
        cuts = np.searchsorted(starts, bounds)
        counts = np.diff(cuts)
        place = np.arange(len(starts)) + np.repeat(np.array(places, np.int64) - cuts[:-1], counts)
        draws = mix(place.astype(_U) * _U(0xD1342543DE82EF95) + np.repeat(np.array([k ^ self.seed for k in keys], _U), counts), 7)
        skip = self._passes(draws) if self.dropout.rate else np.full(len(starts), -1)
        by = np.argsort(sizes, kind="stable")
        by = by[np.searchsorted(sizes[by], 2) :]
        below = 0
        for width in (w for w in WIDTHS if w <= self.widest):
            above = int(np.searchsorted(sizes[by], width, "right"))
            if above > below:
                c = by[below:above]
                self._together(out, pair, starts[c], sizes[c], draws[c], skip[c], width)
            below = above
        for c in by[below:].tolist():
            start, size = int(starts[c]), int(sizes[c])
            symbols = [MARK if x == 32 else chr(x) for x in points[start : start + size].tolist()]
            pieces, _ = self.segment(symbols, self._skips(int(skip[c]), int(draws[c])) if self.dropout.rate else repeat(-1))
            out[start : start + size] = -1
            out[start + np.cumsum([0, *map(len, pieces[:-1])])] = [self.symbol[p] for p in pieces]
        kept = np.flatnonzero(out >= 0)
        ids = self.id_of[out[kept]]
        unknown = np.flatnonzero(ids < 0)
        raw = points[kept[unknown]]
        wide = 1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF)
        n_ids = np.ones(len(ids), np.int64)
        n_ids[unknown] = wide
        at = (np.cumsum(n_ids) - n_ids)[unknown]
        ids = np.repeat(ids, n_ids)
        for j in range(4):
            of = wide > j
            high = raw[of] >> 6 * (wide[of] - 1 - j)
            byte = high & 0x3F | 0x80 if j else high | np.array([0, 0xC0, 0xE0, 0xF0])[wide - 1]
            ids[at[of] + j] = self.fallback[byte]
        ends = np.concatenate(([0], np.cumsum(n_ids)))[np.searchsorted(kept, bounds)]
        ids = ids.astype("<u4")
        return [ids[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], counts

    def _cut(self, text: str) -> Iterator[str]:
        """A text in blocks, which end between chunks."""
        a = 0
        while a < len(text):
            b = min(a + BLOCK, len(text))
            while b < len(text) and MARK not in text[b - 1 : b + 1] and text[b - 1 : b + 1].replace(" ", MARK) in self.beside:
                b += 1
            yield text[a:b]
            a = b

    def encode_all(self, texts: list[str], keys: list[int]) -> Iterator[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers."""
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j]) < BLOCK):
                held += len(texts[j]) + 1
                j += 1
            if j == i + 1:
                found, place = [], 0
                for part in self._cut(" " + texts[i]) if texts[i] else ():
                    ids, counts = self._run([part], keys[i:j], [place])
                    found += ids
                    place += int(counts[0])
                yield b"".join(found)
            else:
                some = [x for x in range(i, j) if texts[x]]
                ids = iter(self._run([" " + texts[x] for x in some], [keys[x] for x in some], [0] * len(some))[0] if some else ())
                yield from (next(ids) if texts[x] else b"" for x in range(i, j))
            i = j

    def encode(self, text: str, key: int = 0) -> bytes:
        return next(self.encode_all([text], [key]))

    def decode(self, ids: bytes) -> bytes:
        """The text's UTF-8 bytes: the opening white space is taken off."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]


@lru_cache(maxsize=2)
def codec(path: str, dropout: Dropout) -> Codec:
    return Codec(path, dropout)


def encode(docs: DataFrame, model: str, dropout: Dropout = Dropout()) -> DataFrame:
    """Rows (doc_id, ids): piece ids of every text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, dropout)
        for batch in slices(batches):
            keys = [c.key(d) for d in column(batch, "doc_id").to_pylist()]
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode_all([t or "" for t in column(batch, "text").to_pylist()], keys)]
            bounds = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))], names=["doc_id", "ids"])

    docs = pick(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids); null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, Dropout(rate=0.0))
        for batch in batches:
            texts = [c.decode(np.array(i or [], "<u4").tobytes()).decode() for i in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(released(run), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, model: str, dropout: Dropout = Dropout()) -> DataFrame:
    """Per document: bytes, pieces, a checksum of the ids, and whether decoding restores the text.

    Ids pass through, null or repeated ones too; null texts count as empty. Rows with equal ids and
    texts have equal pieces. A text is encoded whole, however long. Further columns of the table
    are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, dropout)
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            keys, texts = [c.key(d) for d in column(batch, "doc_id").to_pylist()], [t or "" for t in column(batch, "text").to_pylist()]
            for ids, t in zip(c.encode_all(texts, keys), texts, strict=True):
                raw = t.encode()
                for o, x in zip(out, (len(raw), len(ids) // 4, zlib.crc32(ids), c.decode(ids) == raw), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.bool_())], names=["doc_id", "n_bytes", "n_pieces", "ids_crc32", "lossless"])

    docs = pick(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean")
