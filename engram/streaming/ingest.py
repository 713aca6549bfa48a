"""Streaming: dialog ingestion, access tracking, rate limits and event windows on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.functions.text import lexical_contradiction, merge_content, resolve
from engram.operators.vector import dedup_match, named_match
from engram.schema import Vocabulary


def ingest_batch(entities: DataFrame, incoming: DataFrame, v: Vocabulary = Vocabulary(), threshold: float = 0.88, detect: Callable[[Column, Column], Column] = lexical_contradiction, resolver: Callable[[Column], Column] = resolve) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, contradiction edges, rejected) for extracted ``incoming(id, category, content, embedding)``.

    All matches are found against the state before the batch. A match without contradiction is merged; with one,
    the existing entity's confidence decides between keeping both, joined by an edge, and preferring the new one, which
    archives the old. Undeclared categories are rejected. ``detect`` and ``resolver`` may be replaced.

    A column ``about`` names the entity that a row restates: the row matches that one or none, and is not searched for.
    """
    known = F.col("category").isin(*v.categories)
    rejected, good = incoming.where(~F.coalesce(known, F.lit(False))), incoming.where(known)
    if "about" in incoming.columns:
        match = named_match(entities, good.select(F.col("id").alias("query_id"), "embedding", "about"), threshold)
    else:
        match = dedup_match(entities, good.select(F.col("id").alias("query_id"), "embedding"), threshold)
    old = entities.select(F.col("id").alias("match_id"), F.col("content").alias("old_content"), F.col("confidence").alias("old_confidence"))
    both = good.join(match.withColumnRenamed("query_id", "id"), "id").join(old, "match_id", "left")
    action = F.when(F.col("match_id").isNull(), "create").when(detect(F.col("old_content"), F.col("content")), resolver(F.col("old_confidence"))).otherwise("merge")
    acted = both.withColumn("action", action)
    changed = acted.select(
        F.when(F.col("action") == "merge", F.col("match_id")).otherwise(F.col("id")).alias("id"), "category",
        F.when(F.col("action") == "merge", merge_content(F.col("old_content"), F.col("content"))).otherwise(F.col("content")).alias("content"),
        "embedding", "action", F.when(F.col("action") == "prefer_incoming", F.col("match_id")).alias("archives"),
    )
    links = acted.where("action = 'keep_both'").select(F.col("id").alias("source_id"), F.col("match_id").alias("target_id"), F.lit("contradicts").alias("relation_type"), F.lit(1.0).alias("weight"))
    return changed, links, rejected


def ingest_stream(messages: DataFrame, extract: Callable[[DataFrame], DataFrame], state: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame, DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Micro-batches of dialog messages through extraction and ``ingest_batch``.

    ``apply(changes, links, rejected, batch_id)`` writes keyed upserts, so a repeated batch id is harmless; progress is
    the stream's checkpoint.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        apply(*ingest_batch(state(), extract(df)), batch_id)

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(pending: DataFrame, path: str) -> None:
    """Messages that a stopping worker could not finish, appended as JSON lines, one file per partition."""
    pending.write.mode("append").json(path)


def undrained(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The messages that ``drain`` left, for the next run."""
    return spark.read.schema(schema).json(path)


def every(ticks: DataFrame, run: Callable[[int], None], checkpoint: str, interval: str = "1 hour") -> StreamingQuery:
    """``run(batch_id)`` at each trigger of ``ticks``, such as a rate stream: the ticker of sweeps."""
    return ticks.writeStream.foreachBatch(lambda _, batch_id: run(batch_id)).trigger(processingTime=interval).option("checkpointLocation", checkpoint).start()


def paired(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream-stream join: events of ``right(key, ts)`` at most ``within`` after one of ``left(key, ts)``; state ends by watermark."""
    a = left.select(F.col(key).alias("k"), F.col("ts").alias("left_ts"), F.struct("*").alias("left")).withWatermark("left_ts", late)
    b = right.select(F.col(key).alias("rk"), F.col("ts").alias("right_ts"), F.struct("*").alias("right")).withWatermark("right_ts", late)
    near = (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("k") == F.col("rk")) & near).select(F.col("k").alias(key), "left_ts", "right_ts", "left", "right")


def access_updates(accesses: DataFrame) -> DataFrame:
    """The last access of each id in a batch of ``(id, accessed_ms)``."""
    return accesses.groupBy("id").agg(F.max("accessed_ms").alias("last_accessed_ms"))


def token_bucket(requests: DataFrame, rate: float, burst: int, idle_ms: int = 600_000) -> DataFrame:
    """``(key, ts_ms, allowed)``: a token bucket per key as a stateful stream operator; idle keys are dropped.

    ``requests(key, ts_ms)``. State is two numbers per key.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(burst), -1)
        for df in batches:
            out = []
            for ts in df["ts_ms"].sort_values():
                tokens = min(float(burst), tokens + (max(0, ts - last) * rate / 1000 if last >= 0 else 0))
                last, allowed = max(last, int(ts)), tokens >= 1
                tokens -= allowed
                out.append((key[0], int(ts), bool(allowed)))
            yield pd.DataFrame(out, columns=["key", "ts_ms", "allowed"])
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)

    return requests.groupBy("key").applyInPandasWithState(step, "key string, ts_ms bigint, allowed boolean", "tokens double, last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_windows(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per type in tumbling or sliding windows with a watermark; works on batch and stream alike."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows per user."""
    return events.withWatermark(time, late).groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
