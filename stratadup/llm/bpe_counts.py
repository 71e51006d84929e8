"""Token counts by byte-pair merging, without producing identifiers.

Each pre-token is a linked list of symbols; a heap holds the ranks of adjacent pairs. The
lowest rank (leftmost on a tie) is merged until no pair is left, and the count is the number
of symbols minus the number of merges. Counts of white-space separated chunks are remembered
in a bounded table per worker; what does not fit is computed again.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from stratadup.llm.textkit import Memo, column, pick, released

MEMO_BYTES = 64 << 20
_PLAIN_LIMIT = "ɐ"  # below it the regex module and the library agree on letters and digits


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [others.get(b, chr(b)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging adjacent pairs, lowest rank first."""
    n = len(symbols)
    if n == 1:
        return 1
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    symbols = list(symbols)
    after, before, left = list(range(1, n)) + [-1], list(range(-1, n - 1)), n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        k = after[i] = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return left


class WordBpeCounter:
    """Counts as the library gives them for a vocabulary with word ends that drops white space."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        spec = json.load(open(path))
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_file(path)
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        special = [a["content"] for a in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.alphabet = byte_alphabet()
        self.pieces = Memo(self._piece, memo_bytes // 4)
        self.chunks = Memo(self._chunk, memo_bytes * 3 // 4)
        self.spaces = regex.compile(r"\p{White_Space}+")

    def _piece(self, piece: str) -> int:
        symbols = [self.alphabet[b] for b in piece.encode()]
        symbols[-1] += self.end
        return merge_count(symbols, self.ranks)

    def _chunk(self, chunk: str) -> int:
        if max(chunk) < _PLAIN_LIMIT:
            pieces = self.words.findall("".join(map(str.lower, unicodedata.normalize("NFC", chunk))))
            return sum(map(self.pieces.__getitem__, pieces))
        pre = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        total = 0
        for mapped, _ in pre:
            symbols = list(mapped)
            symbols[-1] += self.end
            total += merge_count(symbols, self.ranks)
        return total

    def count(self, text: str) -> int:
        if self.special is not None and "<|" in text and (n := len(self.special.findall(text))):
            return n + sum(self.count(part) for part in self.special.split(text))
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split only
            return sum(map(self.chunks.__getitem__, filter(None, self.spaces.split(text))))
        return sum(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=4)
def counter(path: str) -> WordBpeCounter:
    return WordBpeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed `limit`.

    A null text counts as empty; ids pass through, null or repeated ones too, and equal texts have
    equal counts. A text is counted whole, chunk by chunk, however long. Further columns of the
    table are ignored, whatever their names. `vocabulary` is the path of a tokenizer file that
    every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = column(batch, "text")
            tokens = [count(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    docs = pick(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(released(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
