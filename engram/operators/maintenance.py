"""Statistics, integrity, retention, re-embedding and compression of the memory graph."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators import vector_index
from engram.operators.graph import orphan_edges
from engram.operators.vector import block_pairs
from engram.sources.scratch import Scratch


def graph_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; coverage is 1 without entities."""
    e = entities.agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("archived", F.lit(False))).alias("archived"), F.count("embedding").alias("embedded"))
    g = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("relation_type") == "contradicts").alias("contradictions"))
    return e.crossJoin(g).select("nodes", "edges", "archived", "contradictions", F.when(F.col("nodes") > 0, F.col("embedded") / F.col("nodes")).otherwise(F.lit(1.0)).alias("coverage"))


def category_coverage(entities: DataFrame) -> DataFrame:
    return entities.groupBy("category").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"), F.count_if(F.coalesce("archived", F.lit(False))).alias("archived"))


def integrity(entities: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """Issues ``(code, level, subject)``: missing embeddings, dangling edges, archived entities with embeddings."""
    missing = entities.where("embedding is null or size(embedding) = 0").select("id").orderBy("id").limit(limit)
    ranked = missing.withColumn("i", F.row_number().over(Window.orderBy("id")))  # at most ``limit`` rows
    n = missing.agg(F.count("*").alias("n"))
    few = ranked.crossJoin(n).where("n < 10").select(F.lit("MISSING_EMBEDDING").alias("code"), F.when(F.col("i") > 5, "info").otherwise("warning").alias("level"), F.col("id").cast("string").alias("subject"))
    many = n.where("n >= 10").select(F.lit("MISSING_EMBEDDING"), F.lit("critical"), F.format_string("%s entities", "n"))
    dangling = orphan_edges(entities, edges).orderBy("source_id", "target_id", "relation_type").limit(limit).select(F.lit("DANGLING_EDGE"), F.lit("critical"), F.format_string("%s -> %s", "source_id", "target_id"))
    stale = entities.where("coalesce(archived, false) and size(embedding) > 0").orderBy("id").limit(limit).select(F.lit("ARCHIVE_CONSISTENCY"), F.lit("warning"), F.col("id").cast("string"))
    return few.union(many).union(dangling).union(stale)


def retention_candidates(entities: DataFrame, ttl_hours: float = 90 * 24.0, batch: int | None = 500, category: str = "observation") -> DataFrame:
    """Live entities of a category older than the TTL, oldest first."""
    old = entities.where((F.col("category") == category) & ~F.coalesce("archived", F.lit(False)) & (F.col("age_hours") > ttl_hours)).select("id", "age_hours")
    return old if batch is None else old.orderBy(F.desc("age_hours"), "id").limit(batch)


def low_confidence(entities: DataFrame, threshold: float = 0.7, stale_hours: float = 30 * 24.0, batch: int | None = 200) -> DataFrame:
    """Live entities with 0 < confidence < threshold that are stale."""
    c = F.col("confidence")
    old = entities.where((c > 0) & (c < threshold) & ~F.coalesce("archived", F.lit(False)) & (F.col("age_hours") > stale_hours)).select("id", "confidence", "age_hours")
    return old if batch is None else old.orderBy(F.desc("age_hours"), "id").limit(batch)


def archive(entities: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return entities.join(hit, "id", "left").withColumn("archived", F.coalesce("_hit", "archived")).drop("_hit").select(*entities.columns)


def needs_reembedding(entities: DataFrame, dim: int, category: str | None = None) -> DataFrame:
    df = entities.where(F.col("embedding").isNull() | (F.size("embedding") != dim))
    return df if category is None else df.where(F.col("category") == category)


def reembed(entities: DataFrame, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Embeddings from an injected function over batches of content."""
    rest = [c for c in entities.columns if c != "embedding"]

    def run(batches):
        for df in batches:
            yield df.assign(embedding=embed(df["content"]))[[*rest, "embedding"]]

    kinds = ", ".join(f"`{c}` {t}" for c, t in entities.select(*rest).dtypes)
    return entities.select(*rest).mapInPandas(run, f"{kinds}, embedding array<float>")


def greedy_clusters(entities: DataFrame, scratch: Scratch, threshold: float = 0.75, least: int = 2, most: int = 10, index: vector_index.Index | None = None) -> DataFrame:
    """Greedy clusters by id: ``(cluster, id)``, cluster = its seed.

    The first free entity takes all free ones at or above the threshold; members beyond ``most`` leave the pool as well.
    Similar pairs come from the join of ``index`` if one is given, else from all block pairs; both are exact. Taking an entity depends only on smaller ids that are linked to it, so rounds
    settle every entity whose smaller neighbours are settled, as the lexicographically first independent set does.
    """
    pairs = scratch.save((vector_index.similar(index, threshold) if index else block_pairs(entities, threshold=threshold)).select("a", "b"), "cluster_pairs")
    ids = scratch.save(entities.where("not coalesce(archived, false) and embedding is not null").select("id"), "cluster_ids")
    # seeds: an entity is a seed if no smaller neighbour is one
    state = scratch.save(ids.withColumn("seed", F.lit(None).cast("boolean")), "state0")
    i = 0
    while not state.where("seed is null").isEmpty():
        i += 1
        smaller = pairs.join(state.select(F.col("id").alias("a"), "seed"), "a").groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("seed", F.lit(False))).alias("taken"), F.bool_or(F.col("seed").isNull()).alias("waiting"))
        joined = state.join(smaller, "id", "left")
        new = F.when(F.col("seed").isNotNull(), F.col("seed")).when(F.coalesce("taken", F.lit(False)), F.lit(False)).when(~F.coalesce("waiting", F.lit(False)), F.lit(True))
        state = scratch.save(joined.select("id", new.alias("seed")), f"state{i}")
    seeds = state.where("seed").select(F.col("id").alias("a"))
    owned = pairs.join(seeds, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("cluster"))
    members = owned.union(seeds.select(F.col("a").alias("id"), F.col("a").alias("cluster")))
    w = Window.partitionBy("cluster")
    return members.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("id"))).where((F.col("n") >= least) & (F.col("i") <= most)).select("cluster", "id")


def compression_dialog(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster the ``[category] content`` lines for a summarizer, members and mean confidence."""
    rows = clusters.join(entities.select("id", "category", "content", "confidence"), "id")
    line = F.format_string("[%s] %s\n", "category", "content")
    return rows.groupBy("cluster").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "").alias("dialog"),
        F.sort_array(F.collect_list("id")).alias("compressed_from"),
        F.avg("confidence").alias("confidence"),
    )


MAX_GENERATION = 3


def compress(entities: DataFrame, clusters: DataFrame, summarize: Callable[[DataFrame], Column], generation: int = 1) -> DataFrame:
    """Summary nodes of clusters: content from ``summarize`` (a column over dialog and members), members, generation."""
    if generation > MAX_GENERATION:
        raise ValueError(f"summaries go up to generation {MAX_GENERATION}")
    rows = compression_dialog(entities, clusters)
    return rows.select("cluster", summarize(rows).alias("content"), "compressed_from", "confidence", F.lit(generation).alias("generation"))


def recompress(summaries: DataFrame, clusters: DataFrame, summarize: Callable[[DataFrame], Column]) -> DataFrame:
    """Summaries of summaries: the next generation over clusters of summary nodes ``(cluster, id)``; at most the third."""
    nodes = summaries.select(F.col("cluster").alias("id"), F.lit("summary").alias("category"), "content", "confidence", "generation").where(F.col("generation") < MAX_GENERATION)
    top = clusters.join(nodes.select("id", "generation"), "id").groupBy("cluster").agg((F.max("generation") + 1).alias("generation"))
    rows = compression_dialog(nodes, clusters)
    return rows.select("cluster", summarize(rows).alias("content"), "compressed_from", "confidence").join(top, "cluster")


def regenerate(summaries: DataFrame, entities: DataFrame, stale: DataFrame, summarize: Callable[[DataFrame], Column]) -> DataFrame:
    """Summary nodes with those named by ``stale(cluster)`` written anew from their members."""
    members = summaries.join(stale.select("cluster"), "cluster", "left_semi").select("cluster", F.explode("compressed_from").alias("id"), "generation")
    fresh = compress(entities, members.select("cluster", "id"), summarize).drop("generation").join(members.select("cluster", "generation").distinct(), "cluster")
    return summaries.join(stale.select("cluster"), "cluster", "left_anti").unionByName(fresh.select(*summaries.columns))


def sweep(entities: DataFrame, ttl_hours: float = 90 * 24.0, threshold: float = 0.7, stale_hours: float = 30 * 24.0) -> DataFrame:
    """One retention pass: expired observations and stale low-confidence entities become archived."""
    gone = retention_candidates(entities, ttl_hours, None).select("id").union(low_confidence(entities, threshold, stale_hours, None).select("id"))
    return archive(entities, gone)


def compact(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrite a table with files of bounded rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
