"""Retrieval metrics, confusion metrics, percentiles and histograms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.ranks import global_rank
from engram.sources.scratch import Scratch

#: Upper bounds of the latency histogram, in seconds.
BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


@dataclass(frozen=True)
class Labels:
    """Judgements by label: a document is judged for every query of its label. ``queries(query_id, label)`` and
    ``docs(doc_id, label)``, with ``relevance`` where it is graded, take the place of all pairs of the two."""

    queries: DataFrame
    docs: DataFrame

    def pairs(self) -> DataFrame:
        """``(query_id, doc_id)`` and the grade: as many rows as a label has queries times documents."""
        return self.queries.join(self.docs, "label").drop("label")


Judgements = DataFrame | Labels


def hits(results: DataFrame, qrels: Judgements) -> DataFrame:
    """Results with ``rel``: 1 where (query_id, doc_id) is judged relevant. ``rank`` counts from 1."""
    if isinstance(qrels, Labels):
        asked = results.select("query_id", "doc_id").distinct().join(qrels.queries, "query_id")
        judged = asked.join(qrels.docs.select("doc_id", "label"), ["doc_id", "label"], "left_semi").select("query_id", "doc_id").distinct()
    else:
        judged = qrels.select("query_id", "doc_id").distinct()
    return results.join(judged.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def totals(qrels: Judgements) -> DataFrame:
    """``(query_id, n)``: judged documents of every query with judgements."""
    if isinstance(qrels, Labels):
        size = qrels.docs.select("label", "doc_id").distinct().groupBy("label").agg(F.count("*").alias("n"))
        return qrels.queries.select("query_id", "label").distinct().join(size, "label").groupBy("query_id").agg(F.sum("n").alias("n"))
    return qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))


def precision_recall(results: DataFrame, qrels: Judgements, k: int) -> DataFrame:
    """Micro precision and recall at k: one row."""
    top = hits(results, qrels).where(F.col("rank") <= k).agg(F.sum("rel").alias("h"), F.count("*").alias("n"))
    total = totals(qrels).join(results.select("query_id").distinct(), "query_id", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("r"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return top.crossJoin(total).select(share("h", "n").alias("precision"), share("h", "r").alias("recall"))


def mrr(results: DataFrame, qrels: Judgements) -> DataFrame:
    """Mean over queries with judgements of 1 / first relevant rank, 0 if none."""
    first = hits(results, qrels).where("rel = 1").groupBy("query_id").agg(F.min("rank").alias("r"))
    return totals(qrels).select("query_id").join(first, "query_id", "left").agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


def ndcg(results: DataFrame, qrels: Judgements, k: int) -> DataFrame:
    """Binary nDCG at k per query with judgements."""
    gain = hits(results, qrels).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2((i + 1).cast("double")))
    return totals(qrels).join(gain, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts with accuracy, precision, recall and F1; 0 where a denominator is 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = c.withColumn("accuracy", share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    c = c.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def nearest_rank(df: DataFrame, group: str, value: str, scratch: Scratch, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """``sorted[n * p / 100]`` per group: no interpolation.

    Positions come from range partitions, so a group that holds most rows is not sorted in one task.
    """
    ranked = scratch.save(global_rank(df.select(group, value).where(F.col(value).isNotNull()), [F.col(group), F.col(value)], scratch, "percentile_parts", "i"), "percentile_ranks")
    size = ranked.groupBy(group).agg(F.min("i").alias("first"), F.count("*").alias("n"))
    wanted = size.select(group, "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), (F.col("first") + F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)).alias("i")) for p in percents])).alias("w"))
    found = wanted.select(group, "w.p", "w.i").join(ranked.select("i", value), "i")
    return found.groupBy(group).agg(*[F.max(F.when(F.col("p") == p, F.col(value))).alias(f"p{p}") for p in percents])


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts at fixed bounds: ``(le, n)``."""
    counts = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.*")


def run(retrieve: Callable[[DataFrame], DataFrame], queries: DataFrame, qrels: Judgements, k: int = 10) -> DataFrame:
    """One row of precision, recall, MRR and mean nDCG for an injected retrieval ``queries -> (query_id, doc_id, rank)``."""
    results = retrieve(queries)
    mean = ndcg(results, qrels, k).agg(F.avg("ndcg").alias("ndcg"))
    return precision_recall(results, qrels, k).crossJoin(mrr(results, qrels)).crossJoin(mean)  # one row each


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def relevant(judged: Judgements) -> Judgements:
    """Judgements ``(query_id, doc_id, relevance)`` as binary ones: what has a relevance above 0 is relevant."""
    if isinstance(judged, Labels):
        return Labels(judged.queries, judged.docs.where(F.col("relevance") > 0).drop("relevance"))
    return judged.where(F.col("relevance") > 0).select("query_id", "doc_id")


def reranker_ndcg(order: DataFrame, judged: Judgements, k: int = 10) -> DataFrame:
    """Binary nDCG at k of a reranked order ``(query_id, doc_id, rank)`` by graded judgements, for every judged query.

    A query without a relevant document has an ideal of nothing and scores 0.
    """
    every = totals(judged).select("query_id")
    return every.join(ndcg(order, relevant(judged), k), "query_id", "left").select("query_id", F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"))


def per_query(results: DataFrame, qrels: Judgements, k: int) -> DataFrame:
    """``(query_id, precision, recall, rr, ndcg)`` for every query with results or judgements; 0 where a denominator is 0."""
    top = hits(results, qrels).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum("rel").alias("h"), F.count("*").alias("n"))
    first = hits(results, qrels).where("rel = 1").groupBy("query_id").agg(F.min("rank").alias("r"))
    total = totals(qrels).withColumnRenamed("n", "t")
    every = results.select("query_id").union(total.select("query_id")).distinct()
    df = every.join(top, "query_id", "left").join(first, "query_id", "left").join(total, "query_id", "left").join(ndcg(results, qrels, k), "query_id", "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(F.lit(0.0))
    return df.select("query_id", share("h", "n").alias("precision"), share("h", "t").alias("recall"), F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"), F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"))


METRICS = ("precision", "recall", "rr", "ndcg")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs' ``per_query`` frames, paired by query: ``(metric, n, before, after, difference, wins, losses, ties, t)``.

    ``t`` is the paired t statistic, null where all differences are equal or there is one pair. Queries of one run only are
    left out.
    """
    names = lambda df, side: df.select("query_id", *[F.col(m).alias(f"{side}_{m}") for m in METRICS])
    both = names(before, "b").join(names(after, "a"), "query_id")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("b"), F.col(f"a_{m}").alias("a")) for m in METRICS])).alias("x")).select("x.*").withColumn("d", F.round(F.col("a") - F.col("b"), 12))
    out = long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("b").alias("before"), F.avg("a").alias("after"), F.avg("d").alias("difference"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"), F.stddev_samp("d").alias("s"))
    return out.withColumn("t", F.when(F.col("s") > 0, F.col("difference") / (F.col("s") / F.sqrt("n")))).drop("s")


def report(results: DataFrame, qrels: Judgements, k: int, dataset: str) -> DataFrame:
    """One row ``(dataset, queries, k, recall, precision, mrr, ndcg)``; queries are those with judgements."""
    n = totals(qrels).agg(F.count("*").alias("queries"))
    mean = ndcg(results, qrels, k).agg(F.avg("ndcg").alias("ndcg"))
    row = n.crossJoin(precision_recall(results, qrels, k)).crossJoin(mrr(results, qrels)).crossJoin(mean)  # one row each
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return row.select(F.lit(dataset).alias("dataset"), "queries", F.lit(k).alias("k"), zero("recall"), zero("precision"), zero("mrr"), zero("ndcg"))


def report_text(rows: DataFrame) -> DataFrame:
    """Reports as ``(dataset, document)``, a line a figure."""
    at = lambda name: F.rpad(F.concat(F.lit(f"{name}@"), F.col("k").cast("string"), F.lit(":")), 14, " ")
    number = lambda c: F.format_string("%.4f", c)
    lines = [
        F.lit("=== Benchmark Report ==="), F.concat(F.rpad(F.lit("Dataset:"), 14, " "), F.col("dataset")), F.concat(F.rpad(F.lit("Queries:"), 14, " "), F.col("queries").cast("string")), F.concat(F.rpad(F.lit("K:"), 14, " "), F.col("k").cast("string")),
        F.lit("--- Metrics ---"), F.concat(at("Recall"), number("recall")), F.concat(at("Precision"), number("precision")), F.concat(F.rpad(F.lit("MRR:"), 14, " "), number("mrr")), F.concat(at("NDCG"), number("ndcg")), F.lit(""),
    ]
    return rows.select("dataset", F.concat_ws("\n", *lines).alias("document"))
