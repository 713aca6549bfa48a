"""Episodic memory: timelines, playback, candidate search, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.vectors import cosine
from engram.operators.ranks import global_rank
from engram.sources.scratch import Scratch

KINDS = ("event", "memory", "task")
EVENT_TYPES = ("message", "action", "observation", "system")


def timeline(events: DataFrame, memories: DataFrame, tasks: DataFrame, entities: DataFrame, task_entities: DataFrame) -> DataFrame:
    """Events, linked memories and linked tasks of episodes in one frame, with an ordinal by (time, kind, source)."""
    e = events.select("episode_id", F.lit("event").alias("kind"), F.col("id").cast("string").alias("source_id"), "type", "content", "timestamp_ms")
    m = memories.join(entities.select(F.col("id").alias("entity_id"), "content"), "entity_id").select("episode_id", F.lit("memory").alias("kind"), F.col("entity_id").cast("string").alias("source_id"), F.col("role").alias("type"), "content", F.col("linked_at_ms").alias("timestamp_ms"))
    t = tasks.join(task_entities.select(F.col("id").alias("task_id"), "content", "status"), "task_id").select("episode_id", F.lit("task").alias("kind"), F.col("task_id").cast("string").alias("source_id"), F.coalesce("status", F.lit("")).alias("type"), "content", F.col("linked_at_ms").alias("timestamp_ms"))
    order = Window.partitionBy("episode_id").orderBy("timestamp_ms", "kind", "source_id", "type", "content")
    return e.unionByName(m).unionByName(t).withColumn("ordinal", F.row_number().over(order))


def playback(timeline: DataFrame) -> DataFrame:
    """Frames with the time since the previous one."""
    order = Window.partitionBy("episode_id").orderBy("ordinal")
    return timeline.select("episode_id", F.col("ordinal").alias("frame"), "kind", "source_id", "content", (F.col("timestamp_ms") - F.lag("timestamp_ms", 1).over(order)).alias("gap_ms"))


def episodes(events: DataFrame) -> DataFrame:
    """Episode bounds and counts from events."""
    return events.groupBy("episode_id").agg(F.min("timestamp_ms").alias("started_at_ms"), F.max("timestamp_ms").alias("ended_at_ms"), F.count("*").alias("n_events"), F.min("user_id").alias("session_id"))


def candidates(episodes: DataFrame, memories: DataFrame, session: int | None = None, start_ms: int | None = None, end_ms: int | None = None, linked: bool = False, limit: int | None = None) -> DataFrame:
    """Episodes by session and time, with linked memories if asked, latest first."""
    if session is not None:
        episodes = episodes.where(F.col("session_id") == session)
    if start_ms is not None:
        episodes = episodes.where(F.col("started_at_ms") >= start_ms)
    if end_ms is not None:
        episodes = episodes.where(F.col("started_at_ms") <= end_ms)
    if linked:
        episodes = episodes.join(memories.select("episode_id"), "episode_id", "left_semi")
    return episodes if limit is None else episodes.orderBy(F.desc("started_at_ms"), "episode_id").limit(limit)


def semantic_rank(episodes: DataFrame, query: list[float], metadata: str = "metadata") -> DataFrame:
    """Episodes by cosine against ``metadata.embedding``; 0 where it is missing."""
    v = F.from_json(F.get_json_object(metadata, "$.embedding"), "array<double>")
    q = F.array(*[F.lit(float(x)) for x in query])
    return episodes.withColumn("similarity", F.coalesce(F.round(cosine(v, q), 6), F.lit(0.0))).orderBy(F.desc("similarity"), "episode_id")


def by_type(events: DataFrame, kind: str) -> DataFrame:
    if kind not in EVENT_TYPES:
        raise ValueError(f"unknown event type {kind}")
    return events.where(F.col("type") == kind).select("episode_id", "id", "content", "timestamp_ms")


def memories_of(memories: DataFrame, entities: DataFrame) -> DataFrame:
    return memories.join(entities.select(F.col("id").alias("entity_id"), "category", "content"), "entity_id").select("episode_id", "entity_id", "role", "category", "content")


def link(links: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Links with new ones; existing links win, an empty role is ``extracted``."""
    if "role" in new.columns:
        new = new.withColumn("role", F.coalesce(F.nullif("role", F.lit("")), F.lit("extracted")))
    return links.unionByName(new.join(links.select(*keys), keys, "left_anti").dropDuplicates(keys))


def unlink(links: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return links.join(gone.select(*keys), keys, "left_anti")


def export(frames: DataFrame, form: str = "text") -> DataFrame:
    """Per episode one document: json, markdown or text. A group is one episode."""
    if form == "json":
        line, head, joint = F.to_json(F.struct("frame", "kind", "source_id", "content")), "[", ","
    elif form == "markdown":
        line, head, joint = F.format_string("- **%s** %s", "kind", "content"), "# Episode\n\n", "\n"
    else:
        line, head, joint = F.format_string("[%s] %s", "kind", "content"), "", "\n"
    rows = frames.withColumn("line", line).groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("frame", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), joint)
    return rows.select("episode_id", F.concat(F.lit(head), body, F.lit("]" if form == "json" else "")).alias("document"))


def summary_dialog(events: DataFrame, memories: DataFrame) -> DataFrame:
    """What a summarizer reads: ``[type] content`` lines, then ``[memory:role] content`` lines."""
    e = events.select("episode_id", F.lit(0).alias("part"), F.col("timestamp_ms").alias("t"), F.col("id").alias("i"), F.format_string("[%s] %s\n", "type", "content").alias("line"))
    m = memories.select("episode_id", F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("t"), F.col("entity_id").alias("i"), F.format_string("[memory:%s] %s\n", "role", "content").alias("line"))
    return e.union(m).groupBy("episode_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "t", "i", "line"))), lambda x: x["line"]), "").alias("dialog"))


def insert(table: DataFrame, rows: DataFrame, keys: list[str], types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, rejected): sessions, episodes or events with new rows; known keys stay, undeclared event types are rejected."""
    ok = F.lit(True) if types is None else F.coalesce(F.col("type").isin(*types), F.lit(False))
    good = rows.where(ok).join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return table.unionByName(good, allowMissingColumns=True), rows.where(~ok)


def finish(episodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Episodes with ``ends(episode_id, ended_at_ms, summary)``; an end that is set stays, a summary is replaced."""
    new = ends.select("episode_id", F.col("ended_at_ms").alias("_end"), F.col("summary").alias("_summary")).dropDuplicates(["episode_id"])
    return episodes.join(new, "episode_id", "left").withColumn("ended_at_ms", F.coalesce("ended_at_ms", "_end")).withColumn("summary", F.coalesce("_summary", "summary")).select(*episodes.columns)


def sessions(events: DataFrame) -> DataFrame:
    """``(session_id, started_at_ms, ended_at_ms, n_episodes)`` from events with ``user_id`` as session."""
    return events.groupBy(F.col("user_id").alias("session_id")).agg(F.min("timestamp_ms").alias("started_at_ms"), F.max("timestamp_ms").alias("ended_at_ms"), F.count_distinct("episode_id").alias("n_episodes"))


def session_order(sessions: DataFrame, scratch: Scratch) -> DataFrame:
    """Sessions with ``position``: latest start first, then id. Positions come from range partitions."""
    return global_rank(sessions, [F.col("started_at_ms").desc_nulls_last(), F.col("session_id")], scratch, "sessions", "position")


def episode_order(episodes: DataFrame) -> DataFrame:
    """Episodes with ``position`` in their session: earliest start first, then id."""
    return episodes.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("started_at_ms").asc_nulls_last(), "episode_id")))


def latest_of_type(events: DataFrame, kind: str, n: int) -> DataFrame:
    """The n latest events of a type: time descending, id ascending; a negative n gives none."""
    return by_type(events, kind).orderBy(F.desc("timestamp_ms"), "id").limit(max(0, n))
