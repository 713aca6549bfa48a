"""Scoring, retrieval, text, belief and evaluation functions on known cases."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import scoring, text, vectors
from engram.operators import beliefs, evaluation, vector
from engram.plans import retrieval
from engram.schema import Weights

ENTITY = "id bigint, category string, content string, archived boolean, embedding array<float>, age_hours double, created_hours double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_decay_and_missing_times(spark):
    assert abs(one(spark, scoring.recency(F.lit(720.0))) - math.exp(-1)) < 1e-9
    assert one(spark, scoring.recency(F.lit(None).cast("double"))) == 1.0
    assert one(spark, scoring.temporal(F.lit(None).cast("double"))) == 0.0
    assert one(spark, scoring.recency(F.lit(-5.0))) == 1.0


def test_zero_weights_take_defaults():
    assert Weights(centrality=0.0).with_defaults().centrality == 0.05


def test_cosine_cases(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vectors.cosine(a(1, 0), a(1, 0, 0))) == 0.0
    assert one(spark, vectors.cosine(a(0, 0), a(1, 0))) == 0.0
    assert one(spark, vectors.normalize(a(0, 0))) == [0.0, 0.0]
    q = one(spark, vectors.quantize(a(0, 1, float("nan"))))
    assert (q["min"], q["max"], list(q["codes"])) == (0.0, 1.0, [0, 127, 0])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False), max_size=20))
def test_vector_blob_round_trip(v):
    assert vectors.decode_blob(vectors.encode_blob(v)) == v


def test_blob_of_odd_length_is_an_error():
    with pytest.raises(ValueError):
        vectors.decode_blob(b"abc")


CASES = [
    ("User likes Go", "User likes Go", False), ("User likes Go", "User does not like Go", True), ("User does not like Go", "User does not like Go", False),
    ("User hates Go", "User loves Go", True), ("User does not", "User does", True), ("Я люблю море", "Я не люблю море", True), ("Я люблю это", "Я ненавижу это", True),
    ("Я люблю это", "Я не очень люблю это", False), ("Я любил это", "Я разлюбил это", True), ("Мне нравится это", "Это красиво", False), ("Хочу туда поехать", "Никогда не хочу туда ехать", True),
    ("Я не люблю это", "Я не люблю это", False), ("Я не ненавижу это", "Я ненавижу это", True), ("User loves X", "User не любит X", True), ("Я любит море", "Я не любит море", True),
    ("Я полюбил это", "Я не полюбил это", True), ("Я любит это", "Я любила это", False),
]


def test_lexical_contradictions(spark):
    df = spark.createDataFrame(CASES, "a string, b string, want boolean").withColumn("got", text.lexical_contradiction(F.col("a"), F.col("b")))
    assert [(x["a"], x["b"]) for x in df.where("got <> want").collect()] == []


def test_merge_resolve_tokens(spark):
    assert one(spark, text.merge_content(F.lit("a b"), F.lit("b"))) == "a b"
    assert one(spark, text.merge_content(F.lit("a"), F.lit("b"))) == "a; b"
    assert one(spark, text.resolve(F.lit(0.0))) == "keep_both" and one(spark, text.resolve(F.lit(0.5))) == "prefer_incoming"
    assert one(spark, text.token_count(F.lit("abcd  efghi\n"))) == 3 and one(spark, text.token_count(F.lit(None).cast("string"))) == 0
    assert one(spark, text.strip_fence(F.lit("```json\n{}\n```"))) == "{}" and one(spark, text.parse_list(F.lit("a, b,,"))) == ["a", "b"]


def facts(spark, rows):
    return spark.createDataFrame([(i, c, f"{c} {i}" if x is None else x, False, [1.0, 0.0], 0.0, 0.0) for i, c, x in rows], ENTITY)


def graph_fixture(spark):
    e = spark.createDataFrame([(1, "world", "seed", False, [1.0, 0.0], 0.0, 0.0), (2, "world", "dup", False, [1.0, 0.0], 0.0, 0.0), (3, "opinion", "dup", False, [0.0, 1.0], 0.0, 0.0), (4, "summary", "s", False, [1.0, 0.0], 0.0, 0.0), (5, "opinion", "mine", False, [1.0, 0.0], 0.0, 0.0)], ENTITY)
    edges = spark.createDataFrame([(1, i, "next", 1.0) for i in (2, 3, 4, 5)], "source_id bigint, target_id bigint, relation_type string, weight double")
    return e, edges, spark.createDataFrame([(1,)], "id bigint")


def test_buckets_dedup_budget_render(spark):
    e, edges, seeds = graph_fixture(spark)
    o = retrieval.Options(query=(1.0, 0.0))
    got = retrieval.retrieve(e, edges, seeds, o)
    assert {(x["id"], x["category"]) for x in got.collect()} == {(2, "world"), (5, "opinion")}
    assert {x["id"] for x in retrieval.retrieve(e, edges, seeds, o, tokens=3).collect()} == {2}
    assert retrieval.render(got).first()[0] == "# Memory Context\n\n## world\n- dup (via 'next' from 1)\n\n## opinion\n- mine (via 'next' from 1)\n\n"
    assert retrieval.render(got, "json").first()[0] == '{"opinions":["mine"],"world_facts":["dup"]}'


def test_rerank_and_its_failure(spark):
    e, edges, seeds = graph_fixture(spark)
    got = retrieval.retrieve(e, edges, seeds, retrieval.Options())
    back = retrieval.rerank(got, lambda s: s.str.len())
    assert back.count() == got.count()

    def broken(s):
        raise ValueError

    assert {(x["id"], x["bucket_rank"]) for x in retrieval.rerank(got, broken).collect()} == {(x["id"], x["bucket_rank"]) for x in got.collect()}


def test_multihop_reaches_a_disconnected_part(spark):
    e = spark.createDataFrame([(1, "world", "alpha", False, [1.0, 0.0, 0.0], 0.0, 0.0), (2, "world", "beta", False, [0.0, 1.0, 0.0], 0.0, 0.0), (3, "world", "gamma", False, [0.0, 0.0, 1.0], 0.0, 0.0), (4, "world", "delta", False, [1.0, 0.0, 0.0], 0.0, 0.0)], ENTITY)
    edges = spark.createDataFrame([(1, 2, "x", 1.0), (3, 4, "x", 1.0)], "source_id bigint, target_id bigint, relation_type string, weight double")
    seeds = spark.createDataFrame([(1,)], "id bigint")
    more = retrieval.multihop_seeds(e, edges, seeds)
    assert {x["id"] for x in retrieval.rank(e, edges, more).collect()} == {1, 2, 3, 4}
    assert {x["id"] for x in retrieval.rank(e, edges, seeds).collect()} == {1, 2}


def test_time_filter_touches_seeds_only(spark):
    e, edges, _ = graph_fixture(spark)
    e = e.withColumn("age_hours", F.col("id") * 100.0)
    seeds = spark.createDataFrame([(1,)], "id bigint")
    assert retrieval.rank(e, edges, seeds, retrieval.Options(time_from_hours=150.0)).count() == 5
    assert retrieval.rank(e, edges, seeds, retrieval.Options(time_from_hours=150.0, time_scope="all")).count() == 1


def test_search_limits(spark):
    with pytest.raises(ValueError):
        vector.check_k(501)
    e, _, _ = graph_fixture(spark)
    assert vector.search(e, [1.0, 0.0], 0).count() == 0
    r = vector.search_batch(e, e.select(F.col("id").alias("query_id"), "embedding"), 2, query_block=2)
    assert r.count() == 10 and {x["id"] for x in r.where("query_id = 3 and rank = 1").collect()} == {3}


def test_block_pairs_equal_one_block(spark):
    e, _, _ = graph_fixture(spark)
    key = lambda df: {(x["a"], x["b"], x["similarity"]) for x in df.collect()}
    assert key(vector.block_pairs(e, threshold=0.5, block=2)) == key(vector.block_pairs(e, threshold=0.5))
    rank = lambda b: {(x["a"], x["b"], x["rank"]) for x in vector.nearest(e, 3, b).collect()}
    assert rank(2) == rank(4096)


EV = "belief_id bigint, polarity string, strength double"


@pytest.mark.parametrize("how,rows,want", [("sum", [("support", 0.5), ("support", 0.3), ("refute", 0.2)], (0.8, 0.2)), ("avg", [("support", 0.8), ("support", 0.4), ("refute", 0.6)], (0.6, 0.6)), ("min", [("support", 0.9), ("support", 0.3), ("refute", 0.7), ("refute", 0.1)], (0.3, 0.1)), ("sum", [("support", 1.0)], (1.0, 0.0))])
def test_evidence(spark, how, rows, want):
    r = beliefs.aggregate(spark.createDataFrame([(1, *x) for x in rows], EV), how).first()
    assert (round(r["support"], 6), round(r["refute"], 6)) == want


def test_trust_and_validation(spark):
    assert one(spark, scoring.trust(F.lit(1.0), F.lit("user"), F.lit(0.0))) == 1.0
    assert one(spark, scoring.trust(F.lit(1.0), F.lit("odd"), F.lit(None).cast("double"))) == 0.5
    good, bad = beliefs.validate_evidence(spark.createDataFrame([(1, "support", 0.0), (1, "odd", 0.5), (1, "refute", 2.0), (1, None, 0.1)], EV))
    assert good.first()["strength"] == 1.0 and bad.count() == 3


def test_metrics_on_a_small_run(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "query_id bigint, doc_id bigint, rank int")
    qrels = spark.createDataFrame([(1, 11), (3, 30)], "query_id bigint, doc_id bigint")
    p = evaluation.precision_recall(results, qrels, 2).first()
    assert (round(p["precision"], 6), p["recall"]) == (round(1 / 3, 6), 1.0)
    assert evaluation.mrr(results, qrels).first()["mrr"] == 0.25
    n = {x["query_id"]: round(x["ndcg"], 6) for x in evaluation.ndcg(results, qrels, 10).collect()}
    assert n == {1: round(1 / math.log2(3), 6), 3: 0.0}


def test_as_of_join_takes_the_last_entry(spark):
    h = spark.createDataFrame([(1, 1, 0.1, "A", 10), (1, 2, 0.2, "A", 10), (1, 3, 0.3, "A", 20)], "belief_id bigint, id bigint, confidence double, status string, created_us bigint")
    p = spark.createDataFrame([(1, 5), (1, 10), (1, 25), (2, 5)], "belief_id bigint, at_us bigint")
    assert {(x["belief_id"], x["at_us"], x["id"]) for x in beliefs.state_as_of(h, p).collect()} == {(1, 5, None), (1, 10, 2), (1, 25, 3), (2, 5, None)}
