import random

from stratadup.config import RoutingConfig
from stratadup.operators import fold
from stratadup.streaming import ingest

SCHEMA = "seg_id long, fea array<string>, fps array<string>"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    fps = lambda: [f"{rng.randrange(40):012x}" for _ in range(rng.randrange(1, 9))]
    rows = [(i, (p := fps())[:4], p) for i in range(40)]
    src = str(tmp_path / "src")
    for b in range(4):
        spark.createDataFrame(rows[b * 10 : b * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    cfg = RoutingConfig(policy="guidepost", nodes=3, features=4, gp_size=4, gp_parts=2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    query = ingest.route(stream, cfg).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    got = {r.seg_id: (r.node, r.source, r.dups) for r in spark.read.parquet(out).collect()}
    batch = fold.route(spark.createDataFrame(rows, SCHEMA), cfg).collect()
    assert got == {r.seg_id: (r.node, r.source, r.dups) for r in batch}


def test_stream_of_new_fingerprints(spark, tmp_path):
    src = str(tmp_path / "src")
    for b in range(3):
        spark.createDataFrame([("t", b, i, f"{i + b:012x}") for i in range(5)], "trace string, file_no long, chunk_no long, fp string").coalesce(1).write.mode("append").parquet(src)
    schema = "trace string, file_no long, chunk_no long, fp string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = ingest.new_fingerprints(stream).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == 7
    q = ingest.chunk_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").first().chunks == 15
