import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from stratadup.llm import bpe_counts, merge_dropout, packing, robust_rules, sharding

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts(seed, n=300):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "a", "Bc", "the", ".", ",", "é", "É", "\t", "\xa0", "　", "1", "<|endoftext|>", "<|startoftext|>", "'s", "'S", "你", "\x1c", "́", "Σ", "İ", "ﬁ", "͸", "😀", "<s>", "<0x0A>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 16))) for _ in range(n)]


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), bpe_counts.WordBpeCounter(path, 20_000)
    for text in odd_texts(1, 1500):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_merge_order_is_rank_then_leftmost():
    ranks = {("a", "a"): 1, ("b", "a"): 0, ("aa", "a"): 2}
    assert bpe_counts.merge_count(list("aaba"), ranks) == 2
    assert bpe_counts.merge_count(list("aaa"), ranks) == 1
    assert bpe_counts.merge_count(["x"], ranks) == 1


def test_count_table(docs, texts, nothing):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe_counts.count_tokens(docs, path, 100).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert bpe_counts.count_tokens(nothing, path).count() == 0


def test_byte_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.ByteBpe(path)
    assert own.quick is not None
    letters = "".join(f"a{chr(c)} {chr(c)}1 " for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    texts = [*odd_texts(2, 1500), *[letters[i : i + 10000] for i in range(0, len(letters), 10000)], "ab" * 20000]
    for quick in (own.quick, None):  # and as for other vocabularies
        own.quick = quick
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(range(len(texts)))
    for d, found in pieces.items():
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity,piece,group", [(64, 16, 4), (1024, 256, 96), (32, 32, 1)])
def test_packing_is_complete(docs, texts, capacity, piece, group):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), capacity, piece, group, partitions=2).collect()
    n = check_packing(rows, texts, capacity)
    total = sum(r.length for r in rows)
    if capacity == 64:
        assert n * capacity < 1.15 * total


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, P.path("byte_bpe_50k.json")).count() == 0


def test_differencing_is_even_and_whole():
    rng = np.random.RandomState(0)
    for windows in (1, 2, 7, 32):
        sizes = rng.randint(1, 100, windows * 6)
        sums = np.bincount(packing.differencing(sizes, windows), sizes, windows)
        assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 20
    label = packing.pack_group(np.array([600, 600, 600]), 1024)
    assert len(set(label)) == 3  # two windows would hold them by volume, but not whole


def test_pieces_without_dropout_are_the_library_s():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), merge_dropout.Codec(path, merge_dropout.Dropout(rate=0.0), 30_000)
    for text in odd_texts(3):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text), text


def test_dropout_varies_and_decodes(docs, texts, nothing):
    path = P.path("piece_bpe_32k.model")
    plain, some, other = (merge_dropout.Codec(path, d, 100) for d in (merge_dropout.Dropout(0.0), merge_dropout.Dropout(0.3, 1), merge_dropout.Dropout(0.3, 2)))
    again, different = merge_dropout.Codec(path, merge_dropout.Dropout(0.3, 1), 1), 0
    for text in [*odd_texts(4), *filter(None, texts)]:
        a, b = some.encode(text, 0), other.encode(text, 0)
        assert some.decode(a) == other.decode(b) == plain.decode(plain.encode(text)) == text.encode()
        assert a == again.encode(text, 0)
        different += a != b
    assert different > 50
    none = merge_dropout.Codec(path, merge_dropout.Dropout(1.0), 10)
    assert len(none.encode("the the")) // 4 == len("▁the▁the")
    rows = merge_dropout.round_trip(docs, path).collect()
    assert len(rows) == len(texts) and all(r.lossless for r in rows)
    back = {r.doc_id: r.text for r in merge_dropout.decode(merge_dropout.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert merge_dropout.round_trip(nothing, path).count() == 0


LITERAL = "\ue000"


def plain_agenda(codec, text, key):
    """The ids of a text by a list of symbols that is searched anew for every candidate."""
    if not text:
        return []
    chars = [LITERAL if c == "▁" else "▁" if c == " " else c for c in " " + text]
    neighbours = {x + y for p in codec.ids for x, y in zip(p, p[1:], strict=False)}
    chunks = [[chars[0]]]
    for a, b in zip(chars, chars[1:], strict=False):
        if a + b in neighbours:
            chunks[-1].append(b)
        else:
            chunks.append([b])
    ids = []
    for place, symbols in enumerate(chunks):
        draw = int(merge_dropout.mix(np.array([(place * 0xD1342543DE82EF95 + (key ^ codec.seed)) % 2**64], np.uint64), 7)[0])
        skip, k, met, skipped = int(codec._passes(np.array([draw], np.uint64))[0]), 0, 0, set()
        while True:
            spots = [sum(map(len, symbols[:i])) for i in range(len(symbols))]
            open_ = [(-codec.scores[x + y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in codec.scores and (spots[i], len(x + y)) not in skipped]
            if not open_:
                break
            i = min(open_)[1]
            if met == skip:
                skipped.add((spots[i], len(symbols[i] + symbols[i + 1])))
                k += 1
                skip += 1 + codec._next(draw, k)
            else:
                symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
            met += 1
        for s in symbols:
            ids += [codec.ids[s]] if s in codec.ids else [codec.byte_ids[b] for b in ("▁" if s == LITERAL else s).encode()]
    return ids


def test_dropout_equals_a_plain_agenda(texts):
    codec = merge_dropout.Codec(P.path("piece_bpe_32k.model"), merge_dropout.Dropout(0.3, 5))
    some = [*odd_texts(8, 150), *[t[:300] for t in texts if t], "internationalization  of\n\n(things)... " * 5, "Ünïcode ▁▁ naïve ▁a", " ", "-" * 200]
    for i, (text, ids) in enumerate(zip(some, codec.encode_all(some, list(range(len(some)))), strict=True)):
        assert np.frombuffer(ids, "<u4").tolist() == plain_agenda(codec, text, i), text


def test_long_texts_are_encoded_in_blocks(monkeypatch):
    path = P.path("piece_bpe_32k.model")
    text = "The quick internationalization, of 12,345 things▁ é\n" * 300 + "ab" * 2000
    rates = [merge_dropout.Codec(path, merge_dropout.Dropout(r)) for r in (0.0, 0.2)]
    whole = [c.encode(text, 9) for c in rates]
    monkeypatch.setattr(merge_dropout, "BLOCK", 500)
    assert [c.encode(text, 9) for c in rates] == whole
    assert [b"".join(c.encode_all(["", text, "x", text], [1, 9, 2, 9])) for c in rates] == [w + c.encode("x", 2) + w for w, c in zip(whole, rates, strict=True)]


def measured(text):
    words = SPACES.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered, seen, dup = Counter(triples), set(), set(), 0
    for i, t in enumerate(triples):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if SPACES.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_rules_measure_whole_texts(docs, texts, nothing):
    rows = robust_rules.report(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert tuple(r)[1:7] == measured(texts[r.doc_id] or "")
        assert not (r.base_failed and r.kept)
    assert robust_rules.report(nothing).count() == 0
    odd = docs.union(docs).withColumn("doc_id", F.lit(None).cast("long")).select("*", F.lit("x").alias("TEXT"))
    assert sorted(tuple(r)[1:7] for r in robust_rules.report(odd).collect()) == sorted(2 * [measured(t or "") for t in texts])


def far(x, centre, cov):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def brute_mcd(x, rules, prior=None):
    """The estimate in numpy: starts, trial steps, the least determinant, then further steps."""
    floor = np.diag(np.array(rules.floor))

    def of(rows):
        n, mean, cov = len(rows), rows.mean(0), np.cov(rows.T, bias=True).reshape(4, 4)
        if prior:
            mean, cov = ((n * a + rules.prior * b) / (n + rules.prior) for a, b in zip((mean, cov), prior, strict=True))
        return mean, cov

    def step(estimate):
        cell = np.floor(np.log(far(x, estimate[0], estimate[1] + floor) + 0.001) * rules.grid)
        return of(x[cell <= np.sort(cell)[int(np.ceil(rules.core * len(x))) - 1]])

    q = np.percentile(x, [25, 50, 75], axis=0)
    residue = (x @ np.array([1, 3, 5, 7])) % rules.parts
    starts = [(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2))] + [of(x[residue == r]) for r in range(rules.parts) if (residue == r).any()]
    for _ in range(rules.trial):
        starts = [step(s) for s in starts]
    best = min(starts, key=lambda s: np.linalg.det(s[1] + floor))
    for _ in range(rules.steps - rules.trial):
        best = step(best)
    return best


def test_outliers_equal_brute_force(spark):
    """Groups of 6 to 90 documents, and a language that is too small for verdicts."""
    rng = random.Random(5)
    rows, sizes = [], {("en", "x"): 90, ("en", "y"): 40, ("en", None): 6, ("de", "x"): 60, ("de", "y"): 25, (None, "x"): 12}
    for (lang, source), size in sizes.items():
        for k in range(size):
            words = [rng.choice("abcdefgh") * rng.randrange(2, 9 if lang == "en" else 12) for _ in range(rng.randrange(60, 200))]
            if k % 20 == 5:
                words = [w + "###$$$" for w in words]
            rows.append((len(rows), " ".join(words), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rules = robust_rules.Rules()
    got = {r.doc_id: r for r in robust_rules.judge(docs, rules).collect()}
    x = {i: np.array([got[i][v] for v in robust_rules.VECTOR], float) for i in got if not got[i].base_failed}
    for lang in ("en", "de"):
        whole = brute_mcd(np.array([x[i] for i in x if rows[i][2] == lang]), rules)
        for source in {s for a, s in sizes if a == lang}:
            ids = [i for i in x if rows[i][2:] == (lang, source)]
            centre, cov = brute_mcd(np.array([x[i] for i in ids]), rules, whole)
            want = far(np.array([x[i] for i in ids]), centre, cov + np.diag(rules.floor)) / rules.consistency
            for i, d in zip(ids, want, strict=True):
                assert abs(got[i].distance - d) < 1e-6 * max(d, 1)
    assert all(r.distance is None for i, r in got.items() if rows[i][2] is None)
    junk = {i for i, r in enumerate(rows) if "###" in r[1] and r[2] is not None}
    assert junk <= {i for i, r in got.items() if not r.kept}


def test_shards_follow_the_key(docs, texts, nothing):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    by_shard = {}
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard_documents(nothing).count() == 0
    assert sharding.shard_documents(docs.union(docs)).count() == 2 * len(texts)


def descend(key, tree, seed="tree"):
    """The descent in plain Python."""
    path, left = f"={key}|{seed}", tree
    for level in ("region", "rack", "shard"):
        weight = Counter()
        for s in left:
            weight[getattr(s, level)] += s.weight
        draw = lambda n, w=weight: -math.log((int(hashlib.md5(f"{path}/{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w[n]  # noqa: E731, B023
        best = min(weight, key=lambda n: (draw(n), n))
        path, left = f"{path}/{best}", [s for s in left if getattr(s, level) == best]
    return best


def test_tree_moves_rows_only_to_the_changed_subtree(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    tree = [sharding.Shard(s // 4, s // 2, s, 1.0 + s % 3) for s in range(8)]
    heavy = [s if s.shard != 5 else sharding.Shard(s.region, s.rack, s.shard, 5.0) for s in tree]
    both = sharding.place(sharding.place(keys, "k", tree, "old"), "k", heavy, "new").collect()
    assert all(r.old == descend(r.k, tree) and r.new == descend(r.k, heavy) for r in both[:1500])
    moved = [r for r in both if r.old != r.new]
    assert moved and all(tree[r.new].region == 1 for r in moved)
    assert all(tree[r.new].rack == 2 for r in moved if tree[r.old].region == 1)
    assert all(r.new == 5 for r in moved if tree[r.old].rack == 2)
    total, share = sum(s.weight for s in tree), Counter(r.old for r in both)
    assert all(abs(share[s.shard] / 4000 - s.weight / total) < 0.03 for s in tree)
    # region and rack decide: other trees of the same shards place otherwise
    flat = [sharding.Shard(s.shard, s.shard, s.shard, s.weight) for s in tree]
    assert sum(descend(k, flat) != descend(k, tree) for k in range(500)) > 100
    for n in (1, 7, 16):
        small, large = sharding.uniform_tree(n), sharding.grown(sharding.uniform_tree(n))
        places = [(descend(k, small), descend(k, large)) for k in range(3000)]
        assert all(y in (x, n) for x, y in places) and any(y == n for _, y in places)


def test_slots_of_a_hot_key(spark):
    ids = spark.range(3005).select(F.when(F.col("id") < 3000, F.lit(7)).cast("long").alias("doc_id"))
    got = sharding.shard_documents(ids.select("doc_id", F.lit("same").alias("text"), F.lit("x").alias("TEXT"))).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 3005 and all(sorted(s) == list(range(len(s))) for s in slots.values())
