"""Micro-batch ingestion, rate limits and windows."""

import os

from pyspark.sql import functions as F

from engram.streaming import ingest

ENT = "id bigint, category string, content string, embedding array<float>, confidence double, archived boolean"


def test_ingest_batch_actions(spark):
    e = spark.createDataFrame([(1, "world", "he likes tea", [1.0, 0.0], 0.9, False), (2, "world", "it is cold", [0.0, 1.0], 0.2, False)], ENT)
    new = spark.createDataFrame([(11, "world", "he does not like tea", [1.0, 0.0]), (12, "world", "it is not cold", [0.0, 1.0]), (13, "world", "fresh", [-1.0, 0.0]), (14, "odd", "x", [1.0, 0.0]), (15, "world", "he likes tea a lot", [1.0, 0.0])], "id bigint, category string, content string, embedding array<float>")
    changes, links, rejected = ingest.ingest_batch(e, new)
    got = {x["content"]: (x["id"], x["action"], x["archives"]) for x in changes.collect()}
    assert got["he does not like tea"] == (11, "keep_both", None) and got["it is not cold"] == (12, "prefer_incoming", 2)
    assert got["fresh"] == (13, "create", None) and got["he likes tea; he likes tea a lot"] == (1, "merge", None)
    assert [(x["source_id"], x["target_id"]) for x in links.collect()] == [(11, 1)] and [x["id"] for x in rejected.collect()] == [14]


def test_stream_drains_its_source(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "hello"), (2, "world")], "id bigint, dialog string").write.parquet(src)
    seen = []
    state = spark.createDataFrame([(9, "world", "x", [0.0, 1.0], 1.0, False)], ENT)
    extract = lambda df: df.select("id", F.lit("world").alias("category"), F.col("dialog").alias("content"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    q = ingest.ingest_stream(spark.readStream.schema("id bigint, dialog string").parquet(src), extract, lambda: state, lambda c, links, r, i: seen.extend(x["content"] for x in c.collect()), str(tmp_path / "ckpt"))
    q.awaitTermination(60)
    assert sorted(seen) == ["hello", "world"] and os.path.isdir(tmp_path / "ckpt")


def test_token_bucket_limits_a_burst(spark, tmp_path):
    src = str(tmp_path / "req")
    spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 1100)] + [("b", 0)], "key string, ts_ms bigint").coalesce(1).write.parquet(src)
    df = ingest.token_bucket(spark.readStream.schema("key string, ts_ms bigint").parquet(src), rate=1.0, burst=2)
    q = df.writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(x["key"], x["ts_ms"]): x["allowed"] for x in spark.table("bucket").collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): False, ("a", 1100): True, ("b", 0): True}


def test_windows_and_sessions(spark):
    e = spark.createDataFrame([(1, "x", 0), (1, "x", 600), (1, "y", 7200)], "user_id bigint, event_type string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert {x["n"] for x in ingest.event_windows(e).where("event_type = 'x'").collect()} == {2}
    assert sorted(x["n"] for x in ingest.sessions(e).collect()) == [1, 2]


def test_ticks_run_a_sweep_each(spark, tmp_path):
    ran = []
    q = ingest.every(spark.readStream.format("rate").option("rowsPerSecond", 5).load(), ran.append, str(tmp_path / "t"), "100 milliseconds")
    try:
        for _ in range(600):
            if len(ran) >= 2:
                break
            q.awaitTermination(0.1)
    finally:
        q.stop()
    assert ran[:2] == [0, 1]


def test_what_is_drained_is_read_again(spark, tmp_path):
    path = str(tmp_path / "pending")
    for part in ([(1, "a")], [(2, "b"), (3, None)]):
        ingest.drain(spark.createDataFrame(part, "id bigint, dialog string"), path)
    assert sorted((r["id"], r["dialog"]) for r in ingest.undrained(spark, path, "id bigint, dialog string").collect()) == [(1, "a"), (2, "b"), (3, None)]
