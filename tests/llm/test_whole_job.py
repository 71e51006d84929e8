import random

import numpy as np
import public_tokenizers as P

from stratadup.llm import curve_search, merge_dropout, robust_rules


def test_planted_junk_of_every_coordinate_is_rejected(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    rows, junk = [], {"symbol": [], "line": [], "repeat": []}
    for i in range(400):
        words = [word() for _ in range(rng.randrange(100, 200))]
        text = "\n".join(words)
        if i % 40 == 0:  # 5 % of the characters or more
            junk["symbol"].append(i)
            text = "\n".join(w + "#" if k % 3 == 0 else w for k, w in enumerate(words))
        elif i % 40 == 1:  # 30 % of the lines, but no three words
            junk["line"].append(i)
            text = "\n".join("same" if k % 10 in (0, 3, 6) else w for k, w in enumerate(words))
        elif i % 40 == 2:  # about a third of the words
            junk["repeat"].append(i)
            part = words[: len(words) // 5]
            text = " ".join([*part, *words, word(), *words[-4:]])
        rows.append((i, text, "en", "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in robust_rules.judge(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    for name, ids in junk.items():
        assert not any(got[i].kept for i in ids), name
    plain = set(got) - {i for ids in junk.values() for i in ids}
    assert sum(got[i].kept for i in plain) >= 0.98 * len(plain)


def test_recall_holds_when_three_blocks_are_a_small_part(spark):
    rng = np.random.RandomState(2)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = curve_search.search(table, "vec_id", "embedding", lambda c: c % 80 == 0, 20, curve_search.Curves(block=32)).collect()
    got = {(r.query_id, r.vec_id) for r in found}
    want = set()
    for q in range(0, 4000, 80):
        s = x @ x[q]
        s[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-s)[:20]}
    assert len(got & want) >= 0.9 * len(want)


def test_every_occurrence_is_segmented_for_itself(spark):
    path, word = P.path("piece_bpe_32k.model"), "internationalization"
    docs = spark.createDataFrame([(i, " ".join([word] * 200)) for i in range(20)], "doc_id long, text string")
    rows = merge_dropout.encode(docs, path).collect()
    raw = merge_dropout.Codec(path, merge_dropout.Dropout(0.0)).raw
    seen = []
    for r in rows:
        words, text = [[]], b""
        for i in r.ids:
            if raw[i].startswith(b" ") and words[-1]:
                words.append([])
            words[-1].append(i)
            text += raw[i]
        assert text.decode() == " " + " ".join([word] * 200)
        seen.append({tuple(w) for w in words})
    assert min(map(len, seen)) > 4 and len(set.union(*seen)) > max(map(len, seen))
    few = [merge_dropout.Codec(path, merge_dropout.Dropout(), n) for n in (0, 10**6)]
    for r in docs.collect():
        a, b = (c.encode(r.text, c.key(r.doc_id)) for c in few)
        assert a == b


def test_skips_have_the_dropout_rate():
    codec = merge_dropout.Codec(P.path("piece_bpe_32k.model"), merge_dropout.Dropout(0.1))
    first = [codec._next(d * 0x9E3779B97F4A7C15 & (2**64 - 1), 1) for d in range(20000)]
    for k in range(4):
        assert abs(sum(n >= k for n in first) / 20000 - 0.9**k) < 0.015
    assert codec.encode("the " * 3000, 1) != codec.encode("the " * 3000, 2)
