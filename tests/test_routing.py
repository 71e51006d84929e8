import hashlib
import random
from dataclasses import replace

import pytest

from stratadup.config import RoutingConfig
from stratadup.operators import features, fold, nodes, reports, segments
from stratadup.operators.fold import Router, best_node, victim_part
from stratadup.sources import tables


def test_best_node_cases():
    w = dict(enumerate([1, 100, 1, 1]))
    assert best_node(dict(enumerate([0, 0, 0, 0])), dict.fromkeys(range(4), 0), 4, 1.05) == 0
    assert best_node(dict(enumerate([0, 2, 2, 0])), dict.fromkeys(range(4), 10), 4, 1.05) == 1
    assert best_node(dict(enumerate([0, 3, 0, 0])), w, 3, 1.05) == 1
    assert best_node(dict(enumerate([0, 2, 0, 0])), w, 3, 1.05) == 0


def test_victim_part_cases():
    assert victim_part([], 4) == 3
    assert victim_part([3], 4) == 2
    assert victim_part([0, 1, 2, 3], 4) == 3
    assert victim_part([3, 2, 1, 0], 4) == 0


def stream(seed, n=60, f=4):
    rng = random.Random(seed)
    pool = [hashlib.md5(str(i).encode()).hexdigest()[:12] for i in range(120)]
    out = []
    for _ in range(n):
        at = rng.randrange(100)
        fps = pool[at : at + rng.randrange(2, 14)]
        out.append((sorted(fps)[:f], fps))
    return out


def literal(cfg, items):
    """Stateless, poll-all and poll-some routing from the whole history, without indexes."""
    history, out = [], []
    for fea, fps in items:
        stored = {n: len({f for k, _, p in history if k == n for f in p}) for n in range(cfg.nodes)}
        known = {n: {f for k, e, _ in history if k == n for f in e} for n in range(cfg.nodes)}
        ids = list(range(cfg.nodes)) if cfg.policy == "boafft" else list(dict.fromkeys(int(f[-2:], 16) % cfg.nodes for f in fea))
        score = {n: sum(f in known[n] for f in fea) for n in ids}
        total = sum(stored[n] for n in ids)
        full = [n for n in ids if score[n] == len(fea)]
        load = {n: stored[n] * len(ids) / total for n in ids} if total else {}
        good = [n for n in ids if load and score[n] and load[n] < cfg.skew]
        if full:
            node = full[0]
        elif good:
            node = max(good, key=lambda n: (score[n] / max(load[n], 1), -ids.index(n)))
        else:
            node = min(ids, key=lambda n: (stored[n], ids.index(n)))
        history.append((node, fea, fps))
        out.append(node)
    return out


@pytest.mark.parametrize("policy", ["boafft", "sigma"])
@pytest.mark.parametrize("seed", range(5))
def test_polling_equals_a_literal_model(policy, seed):
    cfg = RoutingConfig(policy=policy, nodes=5, features=4)
    router, items = Router(cfg), stream(seed)
    assert [router.route(i, *x)["node"] for i, x in enumerate(items)] == literal(cfg, items)


@pytest.mark.parametrize("seed", range(4))
def test_prediction_properties(seed):
    cfg = RoutingConfig(policy="guidepost", nodes=5, features=4, gp_size=4, gp_parts=2, shadow=True)
    router, items = Router(cfg), stream(seed) * 2
    for i, (fea, fps) in enumerate(items):
        cached = {n: len(router._part_hits(n, fea)) for n in range(5)}
        true = {n: sum(f in router.rank[n] for f in fea) for n in range(5)}
        assert all(cached[n] <= true[n] for n in cached)
        row = router.route(i, fea, fps)
        assert row["polls"] == (0 if row["source"] == "predicted" else 5)
        assert (row["source"] == "predicted") == (max(cached.values()) > cfg.hit_threshold)
    lru = Router(replace(cfg, policy="boafft", lru=True, lru_size=8))
    for i, (fea, fps) in enumerate(items):
        lru.route(i, fea, fps)
        assert all(len(r) <= 8 for r in lru.recent)


def test_reports_agree_with_closed_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    raw = tables.blocks(docs, docs["source"], docs["doc_id"], docs["text"])
    chunks = segments.with_positions(raw).cache()
    for policy, n in (("boafft", 4), ("boafft", 1), ("stateless_skew", 4), ("guidepost", 4)):
        cfg = RoutingConfig(segment=16, nodes=n, policy=policy, features=4)
        members = segments.members(chunks, segments.segments(chunks, cfg)).cache()
        fea = features.features(members, cfg).cache()
        decisions = fold.route(fold.packed(members, fea), cfg).cache()
        per_node = reports.node_report(members, decisions, fea, cfg).cache()
        total = reports.cluster_report(per_node, cfg).first()
        assert per_node.count() == n
        assert total.logic_block == chunks.count()
        exact = chunks.select("fp").distinct().count()
        assert exact <= total.phy_block <= total.logic_block
        if n == 1:
            assert total.phy_block == exact and total.data_skew == 1
        assert total.phy_block == sum(r.new for r in decisions.collect())
        dups = nodes.dedup(members, decisions)
        assert dups.where("dup").count() == sum(r.dups for r in decisions.collect())
        volumes = reports.route_volumes(decisions, cfg).first()
        polls = sum(r.polls for r in decisions.collect())
        assert volumes.route_connec == (polls or 0) and volumes.route_volume == polls * 32
        index = nodes.feature_index(fea, decisions, cfg)
        if policy == "boafft":
            assert index.count() == total.fea_tab_size
            r = Router(cfg)
            for row in fold.packed(members, fea).orderBy("seg_id").collect():
                r.route(row.seg_id, row.fea, row.fps)
            got = {(x.node, x.fea): x["rank"] for x in index.collect()}
            assert got == {(k, f): v for k in range(n) for f, v in r.rank[k].items()}


def test_matrix_counts_every_decision(spark):
    cfg = RoutingConfig(policy="guidepost", nodes=4, features=4, gp_size=4, gp_parts=2, shadow=True)
    rows = [(i, list(f), list(p)) for i, (f, p) in enumerate(stream(1) * 2)]
    packed = spark.createDataFrame(rows, "seg_id long, fea array<string>, fps array<string>")
    decisions = fold.route(packed, cfg).cache()
    m = reports.prediction_matrix(decisions).first()
    assert m.tp + m.fp + m.tn + m.fn == len(rows) and m.tp > 0
    stats = {r.source: r for r in reports.hit_statistics(decisions).collect()}
    assert sum(r.times for r in stats.values()) == len(rows)
    assert stats["predicted"].first_part_rate >= stats["predicted"].second_part_rate
