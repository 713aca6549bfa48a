"""The memory graph read from Parquet tables.

Entities and typed edges come from the embeddings table, tasks from orders, beliefs from parts with line items as
evidence, episodes from events. All frames are lazy selections over Parquet scans: columns are pruned and filters are
pushed down by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which age is measured, in hours; ages are columns, so no query calls the clock.
CHAIN = 5
JUMPS = (7, 11, 13)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    name = ts if isinstance(ts, str) else None
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector entities: id, embedding, category, content, age in hours, archived, confidence."""
    e = read(spark, sf_dir, "embeddings")
    category = F.element_at(F.array(*[F.lit(c) for c in ("world", "opinion", "experience", "observation")]), (F.col("label") % 4 + 1).cast("int"))
    return e.select(
        F.col("vec_id").alias("id"),
        "embedding",
        "label",
        category.alias("category"),
        F.concat(F.lit("memory "), F.col("label"), F.lit("-"), F.col("vec_id") % 50).alias("content"),
        ((F.col("vec_id") * 37) % 2000).cast("double").alias("age_hours"),
        ((F.col("vec_id") * 53) % 3000).cast("double").alias("created_hours"),
        (F.col("vec_id") % 17 == 0).alias("archived"),
        (((F.col("vec_id") * 13) % 101) / F.lit(100.0)).alias("confidence"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain edges to the next five entities and long-range edges; about eight per entity."""
    ids = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"))
    n = ids.agg(F.count("*").alias("n"))
    wide = ids.crossJoin(F.broadcast(n))  # one row
    chain = wide.select("source_id", "n", F.explode(F.array(*[F.lit(k) for k in range(1, CHAIN + 1)])).alias("k")).select("source_id", (F.col("source_id") + F.col("k")).alias("target_id"), F.lit("next").alias("relation_type"), F.lit(1.0).alias("weight"), "n").where("target_id < n")
    jump = wide.select("source_id", "n", F.explode(F.array(*[F.lit(k) for k in JUMPS])).alias("k")).select("source_id", ((F.col("source_id") + 1) * F.col("k") % F.col("n")).alias("target_id"), F.lit("long-range").alias("relation_type"), F.lit(0.5).alias("weight"), "n")
    return chain.union(jump).drop("n").dropDuplicates(["source_id", "target_id", "relation_type"])


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: id, owner, status, priority, content, archived."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.concat(F.lit("task "), F.col("o_orderkey")).alias("content"), (F.col("o_orderkey") % 23 == 0).alias("archived"), F.lit("task").alias("category"))


def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order blocks the same customer's next one; every third order also has a recovery edge."""
    from pyspark.sql.window import Window

    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    pairs = o.select(F.col("o_orderkey").alias("source_id"), after.alias("target_id")).where("target_id is not null")
    blocking = pairs.withColumn("relation_type", F.lit("blocked_by"))
    recovery = pairs.where("source_id % 3 = 0").withColumn("relation_type", F.lit("recovers_via"))
    return blocking.union(recovery)


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as beliefs: id, content, confidence, source type, status, age, parent and successor."""
    p = read(spark, sf_dir, "part")
    source = F.element_at(F.array(*[F.lit(s) for s in ("user", "observation", "extraction", "inference", "external", "rumour")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    status = F.when(F.col("p_partkey") % 11 == 0, "Superseded").when(F.col("p_partkey") % 13 == 0, "Archived").otherwise("Active")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), ((F.col("p_partkey") % 100) / F.lit(100.0)).alias("confidence"), source.alias("source_type"), status.alias("status"), ((F.col("p_partkey") * 29) % 1500).cast("double").alias("age_hours"), F.when(F.col("p_partkey") % 11 == 0, F.col("p_partkey") + 1).alias("superseded_by"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") - 1).alias("parent_chain_id"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence on parts: belief, polarity, strength."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("belief_id"), F.when(F.col("l_returnflag") == "R", "refute").otherwise("support").alias("polarity"), (1.0 - (F.col("l_discount") + 0.0)).alias("strength"))


def belief_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as confidence log of customers: belief, history id, confidence, time in microseconds."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("belief_id"), F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 97) / F.lit(97.0)).alias("confidence"), F.col("o_orderstatus").alias("status"), micros("o_orderdate").alias("created_us"))


def episode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user's day as an episode: episode, id, type, content, milliseconds, metadata."""
    e = read(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyyMMdd")
    kind = F.element_at(F.array(*[F.lit(s) for s in ("message", "action", "observation", "system")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.concat(F.col("user_id"), F.lit("-"), day).alias("episode_id"), F.col("event_id").alias("id"), kind.alias("type"), F.col("event_type").alias("content"), F.floor(micros("ts") / 1000).alias("timestamp_ms"), F.col("props").alias("metadata"), "user_id", "value")


def episode_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Memories and tasks linked to episodes: (episode, entity, role, ms) and (episode, task, ms)."""
    e = episode_events(spark, sf_dir)
    memories = e.where("id % 3 = 0").select("episode_id", (F.col("id") % 500).alias("entity_id"), F.when(F.col("id") % 2 == 0, "extracted").otherwise("cited").alias("role"), (F.col("timestamp_ms") + 1).alias("linked_at_ms"))
    tasks_ = e.where("id % 5 = 0").select("episode_id", (F.col("id") % 100 + 1).alias("task_id"), (F.col("timestamp_ms") + 2).alias("linked_at_ms"))
    return memories, tasks_
