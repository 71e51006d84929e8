import sys

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, brute_removal
from test_text_operators import check_packing

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == corpus_pipeline.COLUMNS, name
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count() and set(rows) <= set(before)
        if name == "quality_classifier":
            good = [d for d in before if quality.get(d) == 1]
            assert sum(d in rows for d in good) >= 0.95 * len(good)
            assert sum(d in rows for d in before if quality.get(d) == 0) <= 0.2 * sum(quality.get(d) == 0 for d in before) + 1
        elif name == "near_duplicates":
            ids = sorted(before)
            label = brute_components([before[d].text for d in ids])
            assert set(rows) == {ids[i] for i, (_, c) in label.items() if c == i}
        elif name == "repeated_passages":
            ids = sorted(before)
            for d, (n, gone, _) in zip(ids, brute_removal([before[d].text for d in ids]), strict=True):
                if gone == 0:
                    assert rows[d].text == before[d].text
                elif gone < n:
                    assert len(rows[d].text.split()) == n - gone and rows[d].n_chars == len(rows[d].text)
                else:
                    assert d not in rows
        docs, before = out, rows
    ids = sorted(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    pieces["doc_id"] = pieces["doc_id"].map({d: i for i, d in enumerate(ids)})
    check_packing(list(pieces.itertuples(index=False)), [before[d].text for d in ids], 1024)


def test_rows_that_share_an_id_are_judged_apart(spark):
    words = lambda k: " ".join(f"x{(i * (k + 3)) % 997}y{k}" for i in range(80))
    rows = [(5, words(1)), (5, "too short"), (5, words(2)), (7, words(1)), (None, words(2)), (None, words(3)), (2**63 - 1, words(4))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), "other") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string")
    docs = docs.toDF(*corpus_pipeline.COLUMNS, "TEXT")
    kept = corpus_pipeline.quality_rules(spark, docs, "").cache()
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in rows if t != "too short")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, kept, "").collect()}
    assert left == {(5, words(1)), (5, words(2)), (None, words(3)), (2**63 - 1, words(4))}
    passage, own = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(100))
    odd = spark.createDataFrame([(1, passage), (5, passage + " end"), (5, own), (-(2**63), "a b")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    out = {(r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, odd, "").collect()}
    assert out == {(1, passage), (5, "end"), (5, own), (-(2**63), "a b")}


def test_stages_on_odd_tables(spark, docs, nothing):
    sf = "/root/testdata/sf0.001"
    odd = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for table, empty in ((odd, False), (nothing, True)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, sf).cache()
            assert table.columns == corpus_pipeline.COLUMNS, name
            assert bool(table.count()) != empty
        assert table.count() == table.select("doc_id").distinct().count()
        assert bool(corpus_pipeline.STAGES[-1][1](spark, table, sf).count()) != empty
