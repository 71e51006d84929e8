import random
import re
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from model import features as model_features
from model import segments as model_segments
from model import stream

from stratadup.config import RoutingConfig
from stratadup.durable import durable
from stratadup.operators import fold, packs
from stratadup.operators.segments import cut_ends
from stratadup.sources import tables

SF = "/root/testdata/sf0.001"
#: Queries that computed a stream's chunks again for every use of them.
QUERIES = ["gp_part_stats", "report_guidepost", "route_guidepost", "route_guidepost_sigma", "prediction_matrix", "gp_route_volumes", "feat_finesse", "best_container", "route_boafft", "node_dedup", "node_storage", "lineitem_feat_finesse", "hit_features", "feat_cdmink", "feat_ntrans", "segment_chunks", "similarity_probe", "route_sigma", "route_stateless_skew", "report_boafft", "cluster_report", "containers", "feat_mink", "feature_index"]

#: Queries whose joins of growing tables could be broadcast, which took the driver's memory.
BOUNDED = ["best_container", "node_storage", "node_dedup", "feat_cdmink", "feat_ntrans", "report_boafft", "similarity_probe", "feature_index", "report_guidepost", "prediction_matrix", "route_guidepost", "route_guidepost_sigma", "gp_route_volumes", "route_sigma", "route_stateless_skew", "cluster_report", "containers", "feat_finesse", "feat_mink", "route_boafft"]


@pytest.mark.parametrize("name", QUERIES)
def test_the_stream_is_not_computed_again(spark, name):
    import __spark_entry__ as entry

    found = entry.queries()[name](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and not re.search("FlatMapGroupsInPandas", plan)
    sql = entry.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for table in ("documents", "lineitem"):
            db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
        rows = db.execute(sql)
        names = [c[0] for c in rows.description]
        assert sorted(names) == sorted(found.columns)
        assert sorted(found.select(*names).collect()) == sorted(rows.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_packs_equal_the_model(spark, seed):
    rng = random.Random(seed)
    expected = rng.choice([4, 8, 16])
    words = stream(60)
    traces = {f"t{t}": ["00" * 6 if (w := rng.randrange(60)) % 11 == 0 else words[w] for _ in range(rng.choice([1, expected // 2, expected * 2, 150]))] for t in range(6)}
    rows = [(t, i // 7, i % 7, fp) for t, fps in traces.items() for i, fp in enumerate(fps)]
    chunks = spark.createDataFrame(rows, "trace string, file_no long, chunk_no long, fp string")
    cfg = RoutingConfig(segment=expected, features=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # runs that are shorter than segments
    try:
        found = packs.packed(chunks, cfg)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [traces[t][a : b + 1] for t in sorted(traces) for a, b in model_segments(traces[t], expected)]
    assert [(r.seg_id, r.seg_size, r.fps) for r in found.orderBy("seg_id").collect()] == [(k, len(x), "".join(x)) for k, x in enumerate(want, 1)]
    assert [(r.seg_id, r.i, r.fp) for r in packs.members(found).orderBy("seg_id", "i").collect()] == [(k, i, fp) for k, x in enumerate(want, 1) for i, fp in enumerate(x)]
    for method in ("finesse", "mink", "first", "cdmink", "ntrans"):
        got = {}
        for r in packs.features(found, replace(cfg, feature=method)).orderBy("seg_id", "fea_pos").collect():
            assert r.fea_pos == len(got.setdefault(r.seg_id, []))
            got[r.seg_id].append(r.fea)
        assert [got[k] for k in sorted(got)] == [model_features(x, method, 4, expected) for x in want], method


def test_tables_of_long_texts_are_unpacked_in_small_batches(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    key, seen, real = "spark.sql.parquet.columnarReaderBatchSize", [], DataFrame.checkpoint
    before = spark.conf.get(key)
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a: seen.append(int(spark.conf.get(key))) or real(df, *a))
    packs.packed(tables.documents(spark, SF), RoutingConfig())
    assert seen[0] <= 256 and spark.conf.get(key) == before


def _growing(found):
    """Joins of the last execution that were sent to every task, but for those by a trace or a node, of which there are few."""
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan.split("== Initial Plan ==")[0])
    return [k for k in keys if not re.fullmatch(r"(trace|node)#\d+L?", k)]


@pytest.mark.parametrize("name", BOUNDED)
def test_no_table_that_grows_is_sent_to_the_driver(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from pyspark.sql.classic.dataframe import DataFrame

    sent, sizes, real = [], [], DataFrame.checkpoint
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)

    def checkpoint(df, *a):
        sizes.append(spark.conf.get(key))
        out = real(df, *a)
        sent.extend(_growing(df))
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", checkpoint)
    found = entry.queries()[name](spark, SF)
    found.collect()
    assert sent + _growing(found) == []
    assert all(int(s) <= 4 << 20 for s in sizes[:3]) and spark.conf.get(key) == before


def test_a_smaller_size_of_partitions_is_kept(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    key, seen, real = "spark.sql.adaptive.advisoryPartitionSizeInBytes", [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a: seen.append(spark.conf.get(key)) or real(df, *a))
    spark.conf.set(key, "16k")
    try:
        durable(spark.range(9), part_bytes=4 << 20)
        assert seen == ["16384"] and spark.conf.get(key) == "16k"
    finally:
        spark.conf.unset(key)


def test_nulls_are_kept(spark):
    rows = [(None, 1, i, None if i % 3 == 0 else fp) for i, fp in enumerate(stream(40))]
    chunks = spark.createDataFrame(rows, "trace string, file_no long, chunk_no long, fp string")
    found = packs.members(packs.packed(chunks, RoutingConfig(segment=8, features=4))).orderBy("seg_id", "i").collect()
    assert [r.fp for r in found] == [r[3] for r in rows]


def test_runs_are_cut_like_whole_traces():
    rng = np.random.RandomState(5)
    for expected in (2, 4, 16):
        for n in (1, 5, 64, 700):
            for share in (0.0, 0.02, 0.3, 1.0):
                flags = rng.uniform(size=n) < share
                bounds = np.unique(np.concatenate([[0, n], rng.randint(0, n + 1, 9)]))
                cutter, ends = packs.Cutter(expected // 2, expected * 2), []
                for a, b in zip(bounds, bounds[1:], strict=False):
                    ends += [int(a) + e for e in cutter.cut((np.flatnonzero(flags[a:b]) + 1).tolist(), int(b - a))]
                whole = cut_ends(np.flatnonzero(flags) + 1, n, expected // 2, expected * 2).tolist()
                assert ends + [n] * (cutter.held > 0) == whole and cutter.seg - (cutter.held == 0) == len(whole)


@pytest.mark.parametrize("nodes", [3, 11])
def test_stored_fingerprints_equal_sets(nodes):
    rng = random.Random(nodes)
    stored, sets = fold.Stored(nodes), [set() for _ in range(nodes)]
    for _ in range(400):
        node, fps = rng.randrange(nodes), [f"{rng.randrange(30000):012x}" for _ in range(rng.randrange(1, 90))]
        new = stored.put(node, stored.places(packs.keys_of(pa.array(fps))))
        assert new == len(set(fps) - sets[node])
        sets[node] |= set(fps)
        assert stored.count[node] == len(sets[node])


def test_a_stored_fingerprint_takes_few_bytes():
    stored = fold.Stored(8)
    for a in range(0, 1 << 20, 1 << 16):
        stored.put(a >> 16 & 7, stored.places(np.arange(a, a + (1 << 16), dtype=np.uint64) << np.uint64(7)))
    assert sum(stored.count) == 1 << 20 and stored.table.nbytes + stored.bits.nbytes <= 32 << 20


def test_clients_have_nodes_of_their_own(spark):
    cfg = RoutingConfig(policy="boafft", nodes=3, features=4)
    rows = [(c, i, (p := stream(80)[(7 * i + d) % 60 :][:9])[:4], p) for d, c in enumerate("ab") for i in range(30)]
    segments = spark.createDataFrame(rows, "who string, seg_id long, fea array<string>, fps array<string>")
    got = sorted((r.seg_id, r.node, r.hit, r.dups) for r in fold.route(segments, cfg, "who").collect())
    alone = [(r["seg_id"], r["node"], r["hit"], r["dups"]) for c in "ab" for router in [fold.Router(cfg)] for w, i, f, p in rows if w == c for r in [router.route(i, f, p)]]
    assert got == sorted(alone)
