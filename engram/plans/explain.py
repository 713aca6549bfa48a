"""Explanations of retrieval: paths from seeds, score of single nodes, the response document and the explanation tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.scoring import components, composite
from engram.functions.vectors import cosine
from engram.operators.graph import degree
from engram.operators.vector import active, search, search_batch
from engram.plans.retrieval import Options, bucketize, budget, rank, render, retrieve
from engram.schema import BUCKETS, DEPTH_CEILING, Weights


def paths(walked: DataFrame, most: int = DEPTH_CEILING) -> DataFrame:
    """``(id, seed, depth, path, relations)``: the way from the seed to each walked node by its parent pointers.

    ``walked(id, depth, parent_id, relation_type)`` is the whole walk (a node cap may cut parents off). One equi-join a level.
    """
    steps = walked.select(F.col("id").alias("_at"), F.col("parent_id").alias("_up"), F.col("relation_type").alias("_rel"))
    rows = walked.select("id", "depth", F.col("parent_id").alias("_next"), F.array("id").alias("path"), F.when(F.col("parent_id").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("relation_type")).alias("relations"))
    for _ in range(most):
        rows = rows.join(steps, F.col("_next") == F.col("_at"), "left")
        more = F.col("_at").isNotNull()
        rows = rows.select(
            "id", "depth", F.when(more, F.col("_up")).alias("_next"),
            F.when(more, F.concat(F.array("_at"), "path")).otherwise(F.col("path")).alias("path"),
            F.when(more & F.col("_up").isNotNull(), F.concat(F.array("_rel"), "relations")).otherwise(F.col("relations")).alias("relations"),
        )
    return rows.select("id", F.col("path")[0].alias("seed"), "depth", "path", "relations")


def nodes(entities: DataFrame, edges: DataFrame, ids: DataFrame | None = None, query: tuple[float, ...] | None = None, w: Weights = Weights()) -> DataFrame:
    """The score breakdown of entities outside any walk: path weight 0, hence no depth penalty; without a query similarity 0.

    ``ids(id)`` may name any number of them; unknown ids have no row. Archived entities are explained too.
    """
    w = w.with_defaults()
    rows = entities if ids is None else entities.join(ids.select("id").distinct(), "id", "left_semi")
    sim = F.lit(0.0) if query is None else F.coalesce(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), F.lit(0.0))
    c = components(sim, F.col("age_hours"), F.col("created_hours"), F.coalesce("degree", F.lit(0)), F.lit(0.0), w)
    found = rows.join(degree(edges), "id", "left").withColumn("_c", c)
    return found.select("id", "category", "_c.*", composite(F.col("_c"), w).alias("score"))


def response(entities: DataFrame, edges: DataFrame, vector: list[float], o: Options = Options(), k: int = 3, tokens: int | None = None) -> DataFrame:
    """One row ``(document)``: the markdown answer to a query whose ``k`` nearest entities are the seeds."""
    o = Options(**{**o.__dict__, "query": tuple(vector)})
    return render(retrieve(entities, edges, search(entities, vector, k), o, tokens))


def retrieve_many(entities: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 3, o: Options = Options()) -> DataFrame:
    """Facts for many queries at once: ``(query_id, id, depth, category, content, score, bucket_rank)``.

    ``queries(query_id, embedding)``: each walks from its own k nearest entities. Levels of all queries advance together by
    equi-joins on (query, node); the node cap, scores and buckets are per query. Nothing is collected but the query vectors
    of one block of the batch search.
    """
    w = o.weights.with_defaults()
    live = active(entities).select("id", "category")
    both = edges.select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("id"), "weight").union(edges.select("target_id", "source_id", "weight"))
    level = search_batch(entities, queries, k).select("query_id", "id", F.lit(0).alias("depth"), F.lit(0.0).alias("path_weight"))
    seen = level
    for depth in range(1, min(o.max_depth or 2, DEPTH_CEILING) + 1):
        step = level.select("query_id", F.col("id").alias("parent_id"), F.col("path_weight").alias("so_far")).join(both, "parent_id")
        hits = step.groupBy("query_id", "id").agg(F.min(F.col("so_far") + F.coalesce("weight", F.lit(1.0))).alias("path_weight"))
        level = hits.join(live.select("id"), "id", "left_semi").join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(depth).alias("depth"), "path_weight")
        seen = seen.union(level)
    capped = seen.join(live, "id").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "category", "id"))).where(F.col("_n") <= o.max_nodes).select("query_id", "id", "depth", "path_weight")
    vectors = queries.select("query_id", F.col("embedding").alias("_q"))
    found = capped.join(vectors, "query_id").join(entities, "id").join(degree(edges), "id", "left")
    c = components(cosine(F.col("embedding"), F.col("_q")), F.col("age_hours"), F.col("created_hours") if o.walk_temporal else None, F.coalesce("degree", F.lit(0)), F.col("path_weight"), w)
    ranked = found.withColumn("score", composite(c, w)).where(F.col("category").isin(*BUCKETS) & (F.col("depth") > 0))
    best = Window.partitionBy("query_id", "content").orderBy(F.desc(F.round("score", 9)), "id")
    place = Window.partitionBy("query_id", "category").orderBy(F.desc(F.round("score", 9)), "content", "id")
    facts = ranked.withColumn("_f", F.row_number().over(best)).where("_f = 1").withColumn("bucket_rank", F.row_number().over(place))
    return facts.select("query_id", "id", "depth", "category", "content", "score", "bucket_rank")


def _bucket(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), category)


def tree(ranked: DataFrame, question: str, tokens: int | None = None) -> DataFrame:
    """The explanation as text: one row ``(document)`` with the seeds, every fact under the depth of its walk, and counts.

    The lines are those of one retrieval, so they are bounded by its node cap.
    """
    facts = budget(bucketize(ranked), tokens)
    near = lambda s, e: F.struct(*[F.lit(x).alias(n) if not isinstance(x, Column) else x.alias(n) for n, x in zip(("part", "a", "b", "c"), s, strict=True)], e.alias("line"))
    number = lambda x: F.format_string("%.3f", x)
    seed = F.concat(F.lit("  ["), F.col("id").cast("string"), F.lit("] depth=0 score="), number(F.col("score")), F.lit("\n"))
    seeds = ranked.where("depth = 0").select(near((0, F.lit(0), -F.round("score", 9), F.col("id")), seed).alias("x"))
    pad = F.repeat(F.lit("  "), F.col("depth"))
    short = F.when(F.length("content") <= 60, F.col("content")).otherwise(F.concat(F.substring("content", 1, 57), F.lit("...")))
    f = F.col("features")
    why = F.concat(F.lit(" [score="), number(F.col("score")), F.lit(" vec="), number(f["similarity"]), F.lit(" rec="), number(f["recency"]), F.lit(" cent="), number(f["centrality"]), F.lit(" depth="), number(f["depth_penalty"]), F.lit("]\n"))
    via = F.when(F.col("parent_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("  "), pad, F.lit("└─ via '"), F.col("relation_type"), F.lit("' from "), F.col("parent_id").cast("string"), F.lit("\n")))
    line = F.concat(F.lit("  "), pad, F.rpad(F.concat(F.lit("d="), F.col("depth").cast("string")), 12, " "), short, why, via)
    walked = facts.select(near((1, _bucket(F.col("category")), F.lit(0.0), F.col("bucket_rank").cast("bigint")), line).alias("x"))
    kind = lambda df: df.select(F.struct(F.col("x.part").cast("int").alias("part"), F.col("x.a").cast("int").alias("a"), F.col("x.b").cast("double").alias("b"), F.col("x.c").cast("bigint").alias("c"), F.col("x.line").alias("line")).alias("x"))
    text = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("x.part") == part, F.col("x")))), lambda x: x["line"]), "")
    body = kind(seeds).union(kind(walked)).agg(text(0).alias("seeds"), text(1).alias("facts"))
    counts = ranked.where("depth = 0").agg(F.count("*").alias("n")).crossJoin(facts.agg(*[F.count_if(F.col("category") == b).alias(b) for b in BUCKETS]))  # one row each
    head = F.lit(f'Query: "{question}"\n\n── Seeds (vector search) ──\n')
    tail = F.format_string("\n── Summary ──\n  Seeds: %d | World: %d | Opinion: %d | Experience: %d | Observation: %d\n", "n", *BUCKETS)
    either = lambda c, none: F.when(F.col(c) == "", F.lit(none)).otherwise(F.col(c))
    return body.crossJoin(counts).select(F.concat(head, either("seeds", "  (none)\n"), F.lit("\n── Graph walk (edges traversed) ──\n"), either("facts", "  (no facts retrieved)\n"), tail).alias("document"))


def explained(entities: DataFrame, edges: DataFrame, vector: list[float], question: str, k: int = 3, o: Options = Options()) -> DataFrame:
    """``tree`` of a query: its ``k`` nearest entities are the seeds."""
    o = Options(**{**o.__dict__, "query": tuple(vector)})
    return tree(rank(entities, edges, search(entities, vector, k), o), question)
