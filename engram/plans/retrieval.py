"""Context retrieval as one DataFrame plan: walk, score, buckets, rerank, token budget, rendering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.scoring import components, composite, finite
from engram.functions.text import token_count
from engram.functions.vectors import cosine
from engram.operators.graph import degree, walk
from engram.operators.vector import search, search_batch
from engram.schema import BUCKETS, MAX_NODES, Weights


@dataclass(frozen=True)
class Options:
    """``query``: without it similarity is 0. ``walk_temporal``: use creation times inside walks. ``scorer``: the score as an
    expression over the feature struct and the weights, the weighted sum by default."""

    max_depth: int = 2
    max_nodes: int = MAX_NODES
    weights: Weights = Weights()
    query: tuple[float, ...] | None = None
    walk_temporal: bool = False
    time_from_hours: float | None = None
    time_scope: str = "seeds"
    scorer: Callable[[Column, Weights], Column] = composite


def rank(entities: DataFrame, edges: DataFrame, seeds: DataFrame, o: Options = Options()) -> DataFrame:
    """Walked nodes with features and score: expansion and scoring without buckets."""
    young = F.col("age_hours") <= (o.time_from_hours if o.time_from_hours is not None else 0.0)
    if o.time_from_hours is not None:
        seeds = seeds.join(entities.where(young).select("id"), "id", "left_semi")
    w = o.weights.with_defaults()
    nodes = walk(entities, edges, seeds, o.max_depth, max_nodes=o.max_nodes)
    found = nodes.join(entities, "id").join(degree(edges), "id", "left")
    if o.time_from_hours is not None and o.time_scope == "all":
        found = found.where(young)
    sim = F.lit(0.0) if o.query is None else cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in o.query]))
    features = components(sim, F.col("age_hours"), F.col("created_hours") if o.walk_temporal else None, F.coalesce("degree", F.lit(0)), F.col("path_weight"), w)
    found = found.withColumn("features", features)
    return found.withColumn("score", finite(o.scorer(F.col("features"), w))).select("id", "depth", "path_weight", "parent_id", "relation_type", "category", "content", "features", "score")


def bucketize(ranked: DataFrame) -> DataFrame:
    """Facts (depth over 0) of the four buckets, one per content, with their rank in the bucket."""
    best = Window.partitionBy("content").orderBy(F.desc(F.round("score", 9)), "id")
    facts = ranked.where(F.col("category").isin(*BUCKETS) & (F.col("depth") > 0)).withColumn("_first", F.row_number().over(best)).where("_first = 1").drop("_first")
    place = Window.partitionBy("category").orderBy(F.desc(F.round("score", 9)), "content", "id")
    return facts.withColumn("bucket_rank", F.row_number().over(place))


def rerank(facts: DataFrame, score: Callable[[pd.Series], pd.Series], keep_unlisted: bool = True) -> DataFrame:
    """New order inside each bucket by an injected scorer; unlisted facts (null scores) go last or away; on failure the old order."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("bucket_rank")
        try:
            s = score(df["content"])
            df = df.assign(_s=list(s))
            df = df if keep_unlisted else df[df["_s"].notna()]
            df = df.sort_values("_s", ascending=False, kind="stable", na_position="last").drop(columns="_s")
        except Exception:  # noqa: BLE001  a failing model keeps the given order
            pass
        df["bucket_rank"] = range(1, len(df) + 1)
        return df

    return facts.groupBy("category").applyInPandas(one, facts.schema)


def budget(facts: DataFrame, tokens: int | None) -> DataFrame:
    """Facts in bucket order until the first that would exceed the budget; it and all later ones go.

    A fact costs its tokens plus 2. The facts of one retrieval are bounded by its node cap, so one window holds them.
    """
    if not tokens or tokens <= 0:
        return facts
    place = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("category"))
    order = Window.orderBy(place, "bucket_rank").rowsBetween(Window.unboundedPreceding, 0)
    return facts.withColumn("used", F.sum(token_count(F.col("content")) + 2).over(order)).where(F.col("used") <= tokens)


def retrieve(entities: DataFrame, edges: DataFrame, seeds: DataFrame, o: Options = Options(), tokens: int | None = None) -> DataFrame:
    """Buckets of ranked facts within the token budget."""
    return budget(bucketize(rank(entities, edges, seeds, o)), tokens)


def pipeline(*stages: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Stages in order as one transformation."""

    def run(df: DataFrame) -> DataFrame:
        for s in stages:
            df = df.transform(s)
        return df

    return run


def query(entities: DataFrame, edges: DataFrame, vector: list[float], k: int = 3, o: Options = Options(), tokens: int | None = None) -> DataFrame:
    """The nearest entities as seeds, then ``retrieve``."""
    return retrieve(entities, edges, search(entities, vector, k), o, tokens)


def multihop_seeds(entities: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, facts: int = 2, neighbors: int = 3, most: int = 20) -> DataFrame:
    """Seeds after jumps through vector space (fixed values: 2 facts a hop, 3 neighbours each, up to 20 seeds): each hop embeds the best facts of a shallow walk and adds their neighbours.

    A fact's embedding is its stored vector. The seed set is bounded by ``most`` plus one hop's additions, so it is held
    at the driver.
    """
    spark = entities.sparkSession
    have = [r["id"] for r in seeds.select("id").distinct().orderBy("id").collect()]
    current = list(have)
    for hop in range(1, hops):
        if not current or len(have) > most:
            break
        ranked = rank(entities, edges, spark.createDataFrame([(i,) for i in current], "id bigint"), Options(max_depth=1))
        pool = ranked if hop == 1 else ranked.where("depth > 0")
        one = Window.partitionBy("content").orderBy(F.desc(F.round("score", 9)), "id")
        top = pool.withColumn("_n", F.row_number().over(one)).where("_n = 1").orderBy(F.desc(F.round("score", 9)), "content", "id").limit(facts)
        vectors = entities.join(top.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
        near = sorted({r["id"] for r in search_batch(entities, vectors, neighbors).collect()})
        current = [i for i in near if i not in have]
        have += current
    return spark.createDataFrame([(i,) for i in sorted(have)], "id bigint")


def multihop(entities: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, o: Options = Options(), tokens: int | None = None) -> DataFrame:
    """``retrieve`` from the seeds of ``multihop_seeds``: no hop count is 2, one hop is a plain retrieval."""
    hops = hops if hops > 0 else 2
    return retrieve(entities, edges, seeds if hops == 1 else multihop_seeds(entities, edges, seeds, hops), o, tokens)


def explain(ranked: DataFrame) -> DataFrame:
    """Score and features, flat."""
    return ranked.select("id", "depth", "category", "score", "features.*")


def render(facts: DataFrame, form: str = "markdown") -> DataFrame:
    """One row ``(document)``: markdown, text or json, buckets in order. A result is bounded by its node cap."""
    via = F.format_string(" (via '%s' from %s)", "relation_type", "parent_id")
    if form == "json":
        name = F.element_at(F.create_map(*[F.lit(x) for kv in (("world", "world_facts"), ("opinion", "opinions"), ("experience", "experiences"), ("observation", "observations")) for x in kv]), F.col("category"))
        rows = facts.groupBy(name.alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket_rank", "content"))), lambda x: x["content"]).alias("v"))
        return rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("document"))
    dash = "- " if form == "markdown" else "  - "
    line = F.concat(F.lit(dash), F.col("content"), F.when((F.col("depth") > 0) & F.col("parent_id").isNotNull(), via).otherwise(""), F.lit("\n"))
    place = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("category")).alias("o")
    per = facts.withColumn("line", line).groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket_rank", "line"))), lambda x: x["line"]), "").alias("body"))
    head = F.concat(F.lit("## "), F.col("category"), F.lit("\n")) if form == "markdown" else F.concat(F.col("category"), F.lit(":\n"))
    whole = per.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, F.concat(head, "body", F.lit("\n")).alias("text")))), lambda x: x["text"]), "").alias("document"))
    return whole.select(F.concat(F.lit("# Memory Context\n\n" if form == "markdown" else ""), "document").alias("document"))
