import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratadup.llm import curve_search, kneser_ney, line_crf, ngram_join, substring_dedup, textkit
from stratadup.llm.components import components

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_words_of_buffers(texts):
    for lower in (False, True):
        for array in (pa.array(texts), pa.array(texts).slice(7, 40), pa.array(texts, pa.large_string()), pa.array([], pa.string()), pa.array([None, ""])):
            words = textkit.split(array, lower)
            want = [SPACES.findall((t or "").translate(LOWER) if lower else t or "") for t in array.to_pylist()]
            assert words.counts().tolist() == [len(w) for w in want]
            flat = [w for ws in want for w in ws]
            hashes = words.hashes().tolist()
            assert len({*zip(flat, hashes, strict=True)}) == len(set(flat)) == len(set(hashes))


def test_slices_cover_all_rows(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = list(textkit.slices([batch], limit=500))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))


def brute_removal(texts):
    words = [SPACES.findall(t or "") for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    out = []
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [1 << 12, 1 << 28])
def test_removal_equals_brute_force(docs, texts, nothing, bits):
    rows = substring_dedup.remove_repeats(docs, max_bits=bits).collect()
    want = brute_removal(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == dict(enumerate(want))
    assert sum(w[1] for w in want) > 500
    assert substring_dedup.remove_repeats(nothing).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = SPACES.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_links_equal_brute_force(docs, texts, rounds):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs, rounds=rounds).collect()}
    assert got == brute_components(texts)


def test_chains_of_near_copies(spark):
    """Each text is near the next, but the ends are far apart: one component, found by steps."""
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(12):
        text = list(base)
        for i in range(k):
            text[8 * i] = f"n{i}"
        texts.append(" ".join(text))
    texts += texts[:3] + ["other " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()}
    assert got == brute_components(texts) and got[11][1] == 0


def test_links_of_odd_tables(spark, docs, nothing, texts):
    assert ngram_join.link(nothing).count() == 0
    twice = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long"))).select("*", F.lit("another").alias("TEXT"))
    rows = ngram_join.link(twice).collect()
    want = brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    nameless = [r for r in rows if r.doc_id is None]
    assert sorted(r.n_shingles for r in nameless) == sorted(n for n, _ in want.values()) and not any(r.component_id for r in nameless)


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 45), (60, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 45: 40, 50: 40}


def test_model_equals_brute_force(docs, texts, nothing):
    rows = {r.doc_id: r for r in kneser_ney.perplexity(docs).collect()}
    tokens = {d: [*SPACES.findall((t or "").translate(LOWER)), None] for d, t in enumerate(texts)}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    led = lambda t: zip([0, 0, *t[:-2]] if len(t) > 1 else [0], [0, *t[:-1]], t, strict=True)
    count, grams = Counter(), Counter()
    for d, t in tokens.items():
        if not held[d]:
            count.update(t)
            grams.update(led(t))
    n, v = sum(count.values()), len(count)
    pairs = Counter(g[1:] for g in grams)
    cont = Counter(w for _, w in pairs)
    facts = defaultdict(lambda: [0, 0, 0, 0])
    for items in (grams, pairs, {(w,): c for w, c in cont.items()}):
        for g, c in items.items():
            facts[g[:-1]][0] += c
            facts[g[:-1]][min(c, 3)] += 1
    of = lambda items: kneser_ney._discounts([sum(c == k for c in items) for k in (1, 2, 3, 4)])
    discounts = {3: of(grams.values()), 2: of(pairs.values()), 1: of(cont.values())}

    def chance(g):
        """The probability of an n-gram's last word after the others."""
        if not g:
            return 1 / (v + 1)
        c, (total, *classes), d = {3: grams, 2: pairs, 1: {(w,): c for w, c in cont.items()}}[len(g)].get(g, 0), facts.get(g[:-1], (0, 0, 0, 0)), discounts[len(g)]
        lower = chance(g[1:])
        return lower if not total else (max(c - (0, *d)[min(c, 3)], 0) + sum(x * y for x, y in zip(d, classes, strict=True)) * lower) / total

    for context in ((0, 0), (0, "w1"), ("w1", "w2"), ("w2", "never seen")):
        assert abs(sum(chance((*context, w)) for w in count) + chance((*context, "never seen")) - 1) < 1e-9
    assert any(c > 1 for c in grams.values())
    for d, t in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(chance(g)) for g in led(t)), rel_tol=1e-9)
    assert kneser_ney.perplexity(nothing).count() == 0


def test_trigrams_are_counted_without_a_search_for_each():
    rng = np.random.RandomState(3)
    few = rng.randint(0, 9, (2, 500)).astype(np.uint64)
    for counts in (None, rng.randint(1, 5, 500)):
        contexts, at, words, n = kneser_ney._trigrams(*few, counts)
        want = Counter()
        for b, w, c in zip(*few.tolist(), [1] * 500 if counts is None else counts.tolist(), strict=True):
            want[b, w] += c
        assert list(zip(contexts[at].tolist(), words.tolist(), n.tolist(), strict=True)) == sorted((b, w, c) for (b, w), c in want.items())
    before, words = rng.randint(0, 1 << 62, 3_000_000).astype(np.uint64), np.zeros(3_000_000, np.uint64)
    contexts = np.unique(before)

    def least(run):
        took = []
        for _ in range(3):
            began = time.thread_time()
            run()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: kneser_ney._trigrams(before, words)) < least(lambda: np.searchsorted(contexts, before))


def test_sorted_hash_arrays(tmp_path):
    for n in (0, 1, 7, 5000):
        hashes = np.sort(np.random.RandomState(n).randint(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        kneser_ney._save_hashes(str(tmp_path), f"t{n}", hashes)
        kneser_ney._save_counts(str(tmp_path), f"c{n}", np.arange(n))
        assert kneser_ney._places(str(tmp_path), f"t{n}", hashes[::-1]).tolist() == list(range(n))[::-1]
        assert kneser_ney._counts_at(str(tmp_path), f"c{n}", np.arange(n)).tolist() == list(range(n))
        assert (kneser_ney._places(str(tmp_path), f"t{n}", np.arange(1, 100, dtype=np.uint64) << np.uint64(57)) == -1).all()
        assert kneser_ney._unpacked(kneser_ney._packed(hashes, True), True).tolist() == hashes.tolist()


def test_marginals_equal_enumeration():
    rng = np.random.RandomState(0)
    model = line_crf.Model(rng.normal(size=4), rng.normal(size=(2, 2)), np.zeros(3), np.ones(3))
    x, bounds = rng.normal(size=(8, 3)), np.array([0, 3, 4, 8])
    s = x @ model.weights[:-1] + model.weights[-1]
    got = line_crf.marginals(model, s, bounds)
    for a, b in zip(bounds, bounds[1:], strict=False):
        weight, good = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            w = math.exp(sum(s[a + i] * v for i, v in enumerate(y)) + sum(model.moves[p, q] for p, q in zip(y, y[1:], strict=False)))
            weight += w
            good += w * np.array(y)
        assert np.allclose(got[a:b], good / weight)


def test_line_bounds(texts):
    _, size, bounds = line_crf.line_features(pa.array(texts))
    want = [[len(line.encode()) + 1 for line in (t or "").split("\n")] for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    assert size.tolist() == [float(x) for w in want for x in w]


def test_line_scores_equal_those_of_all_features(texts):
    rng = np.random.RandomState(3)
    model = line_crf.Model(rng.normal(size=line_crf.FEATURES + 1), rng.normal(size=(2, 2)), rng.normal(size=line_crf.FEATURES), rng.uniform(0.5, 2, line_crf.FEATURES))
    own, _, bounds = line_crf.line_features(pa.array(texts))
    x = line_crf.with_neighbours(own, bounds)
    want = ((x - model.centre) / model.scale) @ model.weights[:-1] + model.weights[-1]
    assert np.allclose(line_crf.line_scores(model, own, bounds), want)


def test_line_features_equal_counting(texts):
    own, _, bounds = line_crf.line_features(pa.array(texts))
    lines = [line.encode() for t in texts for line in (t or "").split("\n")]
    assert len(lines) == len(own) == bounds[-1]
    for line, x in zip(lines, own, strict=True):
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", line) if w]
        count = lambda chars: sum(b in chars for b in line) / max(len(line), 1)
        assert math.isclose(x[0], math.log1p(len(line))) and math.isclose(x[8], math.log1p(len(words)))
        assert math.isclose(x[4], count(b"0123456789")) and math.isclose(x[2], math.sqrt(count(b"#*$%&|<>")))
        assert math.isclose(x[6], (len(words) - len(set(words))) / max(len(words), 1))
        two = sum(a == 0xC3 and 0x80 <= b <= 0x9E for a, b in zip(line, line[1:], strict=False))
        assert math.isclose(x[1], count(bytes(range(65, 91))) + two / max(len(line), 1))
        marks = {b for b in range(33, 128)} - {*b"#*$%&|<>!?0123456789", *range(65, 91), *range(97, 123)}
        assert math.isclose(x[5], count(marks))


def test_classifier_on_held_out_documents(spark, docs, nothing):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    scored = line_crf.classify(table("documents"), table("labels")).join(table("labels"), "doc_id").where("held_out")
    n, right = scored.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 50 and right >= 0.95 * n
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in line_crf.classify(docs, empty).collect()} == {0.5}
    assert line_crf.classify(nothing, empty).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = curve_search.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_search(rows, k):
    import struct

    f32 = lambda v: [struct.unpack("f", struct.pack("f", x))[0] for x in v]
    good = {i: f32(v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for i in good:
        if i % 5 == 0:
            near = sorted((-sum(a * b for a, b in zip(good[i], good[j], strict=True)), j) for j in good if j != i and len(good[j]) == len(good[i]))
            out[i] = [j for _, j in near[:k]]
    return {i: v for i, v in out.items() if v}


def test_search_among_equal_scores(spark):
    """3,000 different vectors with the same product: the least ids are found."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, math.cos(i) / 2, math.sin(i) / 2]) for i in range(1, 3000)]
    table = vectors(spark, [(i, v, 0) for i, v in rows]).select("*", F.lit(1).alias("EMBEDDING"))
    got = curve_search.search(table, "vec_id", "embedding", lambda c: c == 0, 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {0.5}


def test_search_on_odd_vectors(spark):
    rng = np.random.RandomState(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(120)]
    same = rows[3][1]
    rows += [(i, same) for i in range(200, 260)]
    rows += [(300, None), (305, []), (310, [0.0] * 6), (315, [float("nan")] * 6), (320, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (325, [float("inf")] * 6), (None, same), (330, [1.0, 2.0]), (335, [2.0, 2.0]), (340, [1.0, 2.0]), rows[0]]
    table = vectors(spark, [(i, v, 0) for i, v in rows])
    got = {}
    for r in curve_search.search(table, "vec_id", "embedding", lambda c: c % 5 == 0, 7, curve_search.Curves(block=512)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_search(rows, 7)
    few = vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)])
    assert [tuple(r) for r in curve_search.search(few, "vec_id", "embedding", lambda c: c % 5 == 0, 7).collect()] == [(0, 1, 1, 0.0)]
    assert curve_search.search(few.where("false"), "vec_id", "embedding", lambda c: c % 5 == 0, 7).count() == 0


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = curve_search.search(table, "vec_id", "embedding", lambda c: c % 20 == 0, 20, curve_search.Curves(block=256))
    x = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    rows = []
    for q in ids[ids % 20 == 0]:
        s = m @ x[q]
        s[ids == q] = -np.inf
        rows += [(int(q), int(i)) for i in ids[np.lexsort((ids, -s))[:20]]]
    assert curve_search.recall(found, spark.createDataFrame(rows, "query_id long, vec_id long")) >= 0.9
