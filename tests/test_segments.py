import hashlib
import random

import numpy as np
import pytest
from model import features as model_features
from model import segments as model_segments
from model import stream

from stratadup.config import RoutingConfig
from stratadup.operators import features, fold, segments


def chunk_rows(spark, traces, per_file=7):
    rows = [(t, i // per_file, i % per_file, fp) for t, fps in traces.items() for i, fp in enumerate(fps)]
    return spark.createDataFrame(rows, "trace string, file_no long, chunk_no long, fp string")


def test_golden_segments(spark):
    cfg = RoutingConfig(segment=8, features=4)
    chunks = segments.with_positions(chunk_rows(spark, {"a": stream(40)}))
    got = [(r.st - 1, r.en - 1) for r in segments.segments(chunks, cfg).orderBy("seg_id").collect()]
    assert got == [(0, 3), (4, 17), (18, 21), (22, 30), (31, 35), (36, 39)]


GOLDEN = {
    "finesse": "1679091c5a88 45c48cce2e2d 6512bd43d9ca 70efdf2ec9b0",
    "mink": "1679091c5a88 45c48cce2e2d 6512bd43d9ca 70efdf2ec9b0",
    "ntrans": "c9f0f895fb98 d3d9446802a4 70efdf2ec9b0 aab3238922bc",
    "cdmink": "a87ff679a2f3 e4da3b7fbbce 1679091c5a88 70efdf2ec9b0",
}


@pytest.mark.parametrize("method", GOLDEN)
def test_golden_features(spark, method):
    cfg = RoutingConfig(segment=8, features=4, feature=method)
    chunks = segments.with_positions(chunk_rows(spark, {"a": stream(40)}))
    members = segments.members(chunks, segments.segments(chunks, cfg))
    got = {}
    for r in features.features(members, cfg).orderBy("seg_id", "fea_pos").collect():
        got.setdefault(r.seg_id, []).append(r.fea)
    assert got[1] == "cfcd208495d5 c4ca4238a0b9 c81e728d9d4c eccbc87e4b5c".split()
    assert got[2] == GOLDEN[method].split()
    if method == "mink":
        eight = RoutingConfig(segment=8, features=4, feature="mink", nodes=8)
        nodes = {}
        for r in fold.candidates(features.features(members, cfg), eight).orderBy("seg_id", "ord").collect():
            nodes.setdefault(r.seg_id, []).append(r.node)
        assert nodes[1] == [5, 1, 4] and nodes[2] == [0, 5, 2]


def test_stateless_nodes(spark):
    cfg = RoutingConfig(segment=8, features=4, nodes=8)
    chunks = segments.with_positions(chunk_rows(spark, {"a": stream(40)}))
    members = segments.members(chunks, segments.segments(chunks, cfg))
    got = {r.seg_id: r.node for r in fold.stateless(members, cfg).collect()}
    assert got[1] == 7 and got[2] == 0


@pytest.mark.parametrize("seed", range(4))
def test_random_streams_equal_the_model(spark, seed):
    rng = random.Random(seed)
    expected = rng.choice([4, 8, 16])
    traces = {}
    for t in range(6):
        n = rng.choice([0, 1, expected // 2, expected * 2, 150])
        words = [rng.randrange(60) if rng.random() < 0.7 else 0 for _ in range(n)]
        fps = [hashlib.md5(str(w).encode()).hexdigest()[:12] for w in words]
        traces[f"t{t}"] = ["00" * 6 if w % 11 == 0 else fp for w, fp in zip(words, fps, strict=True)]
    chunks = segments.with_positions(chunk_rows(spark, traces)).cache()
    cfg = RoutingConfig(segment=expected, features=4)
    got = [(r.trace, r.st - 1, r.en - 1) for r in segments.segments(chunks, cfg).orderBy("seg_id").collect()]
    want = [(t, a, b) for t in sorted(traces) for a, b in model_segments(traces[t], expected)]
    assert got == want
    members = segments.members(chunks, segments.segments(chunks, cfg)).cache()
    for method in ("finesse", "mink", "first", "cdmink", "ntrans"):
        c = RoutingConfig(segment=expected, features=4, feature=method)
        found = {}
        for r in features.features(members, c).orderBy("seg_id", "fea_pos").collect():
            found.setdefault(r.seg_id, []).append(r.fea)
        assert [found[k] for k in sorted(found)] == [model_features(traces[t][a : b + 1], method, 4, expected) for t, a, b in want], method


def test_unknown_settings_are_refused():
    with pytest.raises(ValueError):
        RoutingConfig(policy="magic")
    with pytest.raises(ValueError):
        RoutingConfig(segment=48)


def test_cut_ends_equal_the_model():
    rng = np.random.RandomState(4)
    for expected in (4, 16):
        for n in (0, 1, 5, 64, 700):
            for share in (0.0, 0.02, 0.3, 1.0):
                flags = rng.uniform(size=n) < share
                ends, begin = [], 0
                for i in range(n):
                    size = i - begin + 1
                    if size == expected * 2 or (size >= expected // 2 and flags[i]):
                        ends.append(i + 1)
                        begin = i + 1
                if begin < n:
                    ends.append(n)
                assert segments.cut_ends(np.flatnonzero(flags) + 1, n, expected // 2, expected * 2).tolist() == ends


def test_null_traces_and_files_lose_no_chunks(spark):
    rows = [(t, f, c, stream(60)[i]) for i, (t, f, c) in enumerate((t, f, c) for t in (None, "a") for f in (None, 1) for c in range(4))]
    chunks = spark.createDataFrame(rows, "trace string, file_no long, chunk_no long, fp string")
    placed = segments.with_positions(chunks).collect()
    assert sorted((r.trace, r.pos) for r in placed) == [(t, p) for t in ("", "a") for p in range(1, 9)]
    assert all(r.pos <= 4 for r in placed if r.file_no is None)
