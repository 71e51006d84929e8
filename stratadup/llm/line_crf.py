"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score is linear in features of the line and of its two
neighbours; transitions couple successive lines. With two states, the messages of the
forward-backward pass are one log ratio per line, so a batch of documents advances together,
line by line. A document's quality rises with the mean of its lines' marginals, weighted by
length, through a logistic link fitted on the same sample.

The field is fitted by gradient ascent on a bounded sample of labelled documents, whose lines
all carry the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadup.llm import textkit
from stratadup.llm.textkit import column, pick, released

OWN = 12
FEATURES = 3 * OWN + 2


@dataclass(frozen=True)
class Training:
    """`documents` bounds the sample; longer documents than `lines` lines take no part in it."""

    documents: int = 3000
    lines: int = 200
    rounds: int = 160
    rate: float = 0.15
    penalty: float = 1e-3


@dataclass(frozen=True)
class Model:
    """Weights of the state "good" against "bad", log potentials from (row) to (column), and the
    rising logistic link from a text's mean marginal to its quality."""

    weights: np.ndarray
    moves: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    link: tuple[float, float] = (0.0, 0.0)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every line's own features, line lengths (bytes, plus one), and bounds of texts in lines."""
    words = textkit.split(texts)
    raw, lengths = words.data, _byte_lengths(texts)
    at = np.concatenate(([0], np.cumsum(lengths)))
    doc_of_break = np.flatnonzero(raw == 10)
    # every text has one line more than it has line feeds
    starts = np.sort(np.concatenate((at[:-1], doc_of_break + 1)), kind="stable")
    ends = np.sort(np.concatenate((at[1:], doc_of_break)), kind="stable")
    breaks = np.searchsorted(doc_of_break, at)
    bounds = breaks + np.arange(len(at))
    n = len(starts)
    size = (ends - starts).astype(np.float64)
    chars = np.maximum(size, 1)

    def share(flags) -> np.ndarray:
        return textkit.span_counts(lambda a, b: flags(raw[a:b], raw[a + 1 : b + 1]), len(raw), starts, ends) / chars

    def upper(x: np.ndarray, after: np.ndarray) -> np.ndarray:
        two = x == 0xC3
        two[len(after) :] = False
        two[: len(after)] &= (after >= 0x80) & (after <= 0x9E)
        return ((x >= 65) & (x <= 90)) | two

    hashes = words.hashes()
    # the line of a word: the last one that begins at or before it, among lines with characters
    line = np.searchsorted(starts, words.starts, "right") - 1
    count = np.bincount(line, minlength=n).astype(np.float64)
    keys = textkit.mix(hashes ^ textkit.mix(line.astype(np.uint64), 7), 8)
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    repeat = np.bincount(line[again], minlength=n)
    runs = np.zeros(len(keys), bool)
    runs[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    run = np.bincount(line[runs], minlength=n)
    some = np.maximum(count, 1)
    own = np.stack(
        [
            np.log1p(size),
            share(upper),
            np.sqrt(share(lambda x, _: _KIND[x] == 3)),
            np.sqrt(share(lambda x, _: _KIND[x] == 4)),
            share(lambda x, _: _KIND[x] == 2),
            share(lambda x, _: _KIND[x] == 5),
            repeat / some,
            np.sqrt(run / some),
            np.log1p(count),
            np.log(np.maximum(size - count, 1) / some),
            (count == 0).astype(np.float64),
            np.minimum(share(lambda x, _: x >= 0x80), 1),
        ],
        axis=1,
    )
    return own, size + 1, bounds


def _kinds() -> np.ndarray:
    """Bytes by kind: 1 letters and parts of other characters, 2 digits, 3 symbols, 4 ! and ?, 5 other marks."""
    kind = np.zeros(256, np.uint8)
    kind[33:] = 5
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    kind[list(b"#*$%&|<>")] = 3
    kind[list(b"!?")] = 4
    return kind


_KIND = _kinds()


def with_neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it, and whether it is first or last."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first, last = bounds[:-1], bounds[1:] - 1
    before[first], after[last] = 0, 0
    edge = np.zeros((len(own), 2))
    edge[first, 0], edge[last, 1] = 1, 1
    return np.hstack((own, before, after, edge))


def line_scores(model: Model, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The scores of `with_neighbours` features, without building them."""
    w = model.weights[:-1] / model.scale
    out = own @ w[:OWN] + (model.weights[-1] - model.centre @ w)
    before, after = own @ w[OWN : 2 * OWN], own @ w[2 * OWN : 3 * OWN]
    first, last = bounds[:-1], bounds[1:] - 1
    before[last], after[first] = 0, 0  # they count for the next and the previous line
    out[1:] += before[:-1]
    out[:-1] += after[1:]
    out[first] += w[-2]
    out[last] += w[-1]
    return out


def _byte_lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _messages(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios (good to bad) of forward and backward messages at every line.

    Texts are taken longest first, so those that still have a line at a step come first.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first, last, n = bounds[:-1][order], bounds[1:][order] - 1, n[order]
    active = np.searchsorted(-n, -np.arange(n[0]) if len(n) else np.zeros(0), "left")
    forward, backward = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(active)):
        k = int(active[t])
        a = forward[first[:k] + t - 1]
        forward[first[:k] + t] += np.logaddexp(moves[0, 1], moves[1, 1] + a) - np.logaddexp(moves[0, 0], moves[1, 0] + a)
        at = last[:k] - t + 1
        b = scores[at] + backward[at]
        backward[at - 1] = np.logaddexp(moves[1, 0], moves[1, 1] + b) - np.logaddexp(moves[0, 0], moves[0, 1] + b)
    return forward, backward


def marginals(model: Model, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of "good" at every line."""
    forward, backward = _messages(scores, bounds, model.moves)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, training: Training) -> Model:
    """Penalised conditional likelihood, by Adam. Without lines, all weights stay zero."""
    n_features = features.shape[1] if len(features) else FEATURES
    centre, scale = np.zeros(n_features), np.ones(n_features)
    theta = np.zeros(n_features + 1 + 4)
    if not len(features):
        return Model(theta[:-4], theta[-4:].reshape(2, 2), centre, scale)
    centre, scale = features.mean(0), features.std(0) + 0.05
    x = np.hstack(((features - centre) / scale, np.ones((len(features), 1))))
    n = np.diff(bounds)
    y = np.repeat(labels.astype(np.float64), n)
    inner = np.ones(len(x), bool)
    inner[bounds[1:] - 1] = False  # lines with a line after them in their text
    left = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    seen[1, 1], seen[0, 0] = y[left].sum(), (1 - y[left]).sum()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, training.rounds + 1):
        moves = theta[-4:].reshape(2, 2)
        scores = x @ theta[:-4]
        f, b = _messages(scores, bounds, moves)
        p = 1 / (1 + np.exp(-np.clip(f + b, -60, 60)))
        after = scores[left + 1] + b[left + 1]
        joint = np.stack([np.full(len(left), moves[0, 0]), moves[0, 1] + after, moves[1, 0] + f[left], moves[1, 1] + f[left] + after])
        joint = np.exp(joint - joint.max(0))
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        grad = np.concatenate((x.T @ (y - p), (seen - expected).ravel())) / len(x)
        grad -= training.penalty * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta = theta + training.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), centre, scale)


def fit_link(mean: np.ndarray, labels: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """Penalised logistic regression of labels on mean marginals, by Newton steps."""
    x, theta = np.stack((np.ones_like(mean), mean - 0.5), 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(hessian, x.T @ (labels - p) - penalty * theta), -5, 5)
    return float(theta[0]), max(float(theta[1]), 0.0)


def qualities(model: Model, own: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Every text's quality, from marginals weighted by line length."""
    mean = mean_marginals(model, own, size, bounds)
    return 1 / (1 + np.exp(-np.clip(model.link[0] + model.link[1] * (mean - 0.5), -60, 60)))


def mean_marginals(model: Model, own: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    p = marginals(model, line_scores(model, own, bounds), bounds)
    return np.add.reduceat(size * p, bounds[:-1]) / np.add.reduceat(size, bounds[:-1])


def held_out(key: Column) -> Column:
    """Documents that never train the model: the checksum of the id's digits is a multiple of 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Fit on the labelled documents that are not held out, taken in the order of a hash.

    Of rows that repeat an id the one with the least text hash takes part, of labels the largest.
    Null texts are one empty line.
    """

    def collect_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches):
            own, _, bounds = line_features(column(batch, "text"))
            rows = [(d, q, own[a:b].astype("<f4").tobytes()) for d, q, a, b in zip(column(batch, "doc_id").to_pylist(), column(batch, "quality").to_pylist(), bounds, bounds[1:], strict=False) if b - a <= training.lines]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "quality", "lines"])

    docs, labels = pick(docs, "doc_id", "text"), pick(labels, "doc_id", "quality")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.documents)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most `documents` rows of two numbers
    joined = texts.join(F.broadcast(sample), "doc_id")
    single = joined.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    rows = single.select("doc_id", "quality", "least.text").mapInArrow(released(collect_lines), "doc_id long, quality int, lines binary").toPandas().sort_values("doc_id")
    if not len(rows):
        return fit(np.zeros((0, FEATURES)), np.zeros(1, np.int64), np.zeros(0), training)
    parts = [np.frombuffer(b, "<f4").reshape(-1, OWN) for b in rows["lines"]]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    own, y = np.vstack(parts).astype(np.float64), rows["quality"].to_numpy()
    model = fit(with_neighbours(own, bounds), bounds, y, training)
    mean = mean_marginals(model, own, np.exp(own[:, 0]), bounds)  # the first feature is log(1 + size)
    return replace(model, link=fit_link(mean, y))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`score` and `predicted` of every whole text, beside the columns `keep`.

    Null and empty texts are one empty line. Rows that repeat an id or have none are scored each
    for itself; equal texts have equal scores. A text is scored whole, in numbers of 12 features a
    line. Columns that are not in `keep` are ignored, whatever their names.
    """
    docs = pick(docs, *[c for c in keep if c != "text"], "text")
    rows = docs.withColumn("text", docs["text"].cast("string"))
    names = [c for c in rows.columns if c != "text" or "text" in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches):
            own, size, bounds = line_features(column(batch, "text"))
            total = qualities(model, own, size, bounds)
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in names] + [pa.array(total), pa.array((total >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(released(run), ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """Train on `labels`, score all documents, and say which ones the training never saw."""
    scored = score(docs, train(docs, labels, training))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
