"""Vocabulary fingerprints, re-embedding that resumes, schedules, datasets of judgements, SQL functions and parsing."""

import hashlib
import json
import math
import random
import statistics
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from engram.functions import scoring, sql, text
from engram.operators import evaluation, schedule
from engram.plans import explain
from engram.schema import Vocabulary
from engram.sources import meta
from engram.sources.scratch import Scratch
from engram.sources.versions import Store


def test_fingerprint_of_the_seven_parts(spark, tmp_path):
    v = Vocabulary(categories=("b", "a"), relations=("r",), states=("s2", "s1"), task_categories=("t",), blocking="x", recovery="y<&>", done="s1")
    want = '{"blocking":"x","categories":["a","b"],"recovery":"y\\u003c\\u0026\\u003e","relations":["r"],"stateful":["t"],"states":["s2","s1"],"unblocking":"s1"}'
    assert meta.canonical(v) == want and meta.fingerprint(v) == hashlib.sha256(want.encode()).hexdigest()[:16]
    store = Store(spark, str(tmp_path / "s"))
    assert meta.check_fingerprint(store, v) == ("", meta.fingerprint(v))
    assert meta.check_fingerprint(store, v) == (meta.fingerprint(v),) * 2
    for other in (replace(v, states=("s1", "s2")), replace(v, blocking="z"), replace(v, categories=("a",))):
        stored, current = meta.check_fingerprint(store, other)
        assert stored == meta.fingerprint(v) != current
    assert meta.check_fingerprint(store, replace(v, categories=("a", "b")))[1] == meta.fingerprint(v)  # sets have no order
    meta.store_fingerprint(store, other)
    assert meta.check_fingerprint(store, other) == (meta.fingerprint(other),) * 2


ENT = "id bigint, category string, content string, embedding array<float>, archived boolean"


def entities(spark, n=40):
    rows = [(i, "world", None if i == 0 else "" if i % 10 == 1 else "short" if i % 10 == 2 else "fails" if i % 10 == 3 else f"text {i}", [1.0, 0.0], i % 10 == 4) for i in range(n)]
    return spark.createDataFrame(rows, ENT)


def embed(content: pd.Series) -> pd.Series:
    return pd.Series([None if t == "fails" else [1.0] if t == "short" else [3.0, 4.0, 0.0] for t in content])


def test_reembedding_counts_and_resumes(spark, tmp_path):
    whole = Store(spark, str(tmp_path / "whole"))
    whole.update(lambda tx: (tx.create("entities", entities(spark), ["id"]), meta.put(tx, embedding_dim=2, model_name="old")))
    assert meta.needs_reembedding(whole, 2) == (False, 2) and meta.needs_reembedding(whole, 3) == (True, 2) and meta.needs_reembedding(whole, 2, "new") == (True, 2)
    got = meta.reembed(whole, embed, 3, "new", batch_rows=9)
    assert (got.old_dim, got.new_dim, got.total, got.skipped, got.failed, got.reembedded, got.batches) == (2, 3, 36, 5, 8, 23, 4)
    assert meta.needs_reembedding(whole, 3, "new") == (False, 3) and meta.get(whole, "model_name") == "new"
    rows = {r["id"]: (r["embedding"], r["archived"]) for r in whole.read("entities").collect()}
    assert rows[5] == ([pytest.approx(0.6), pytest.approx(0.8), 0.0], False) and rows[2][0] == rows[3][0] == rows[4][0] == [1.0, 0.0] and len(rows) == 40

    class Dies(Store):
        left = 3

        def _publish(self, version, text):
            Dies.left -= 1
            if Dies.left < 0:
                raise RuntimeError("lost")
            super()._publish(version, text)

    path = str(tmp_path / "died")
    Dies(spark, path).update(lambda tx: (tx.create("entities", entities(spark), ["id"]), meta.put(tx, embedding_dim=2)))
    calls = []
    with pytest.raises(RuntimeError, match="lost"):
        meta.reembed(Dies(spark, path), embed, 3, "new", batch_rows=9)
    again = Store(spark, path)
    assert json.loads(meta.get(again, "reembed"))["done"] == 2 and meta.get(again, "embedding_dim") == "2"
    before = again.version()
    assert meta.reembed(again, lambda s: calls.append(1) or embed(s), 3, "new", batch_rows=9) == got
    assert again.version() == before + 2
    assert {r["id"]: (r["embedding"], r["archived"]) for r in again.read("entities").collect()} == rows


def test_schedules_of_random_graphs(spark):
    rng, weights, links = random.Random(4), {}, []
    for g in range(12):
        ids = [100 * g + i for i in range(rng.randint(1, 12))]
        weights |= {i: rng.randint(0, 9) for i in ids}
        links += [(a, b) for a in ids for b in ids if a < b and rng.random() < 0.3]
    into, out = {}, {}
    level = {}
    for i in sorted(weights):
        above = [a for a, b in links if b == i]
        into[i], level[i] = weights[i] + max((into[a] for a in above), default=0), 1 + max((level[a] for a in above), default=-1)
    for i in sorted(weights, reverse=True):
        out[i] = weights[i] + max((out[b] for a, b in links if a == i), default=0)
    most = max(into.values())
    tasks = spark.createDataFrame(list(weights.items()), "id bigint, weight bigint")
    edges = spark.createDataFrame([(a, b, "blocked_by") for a, b in links] + [(1, 0, "next"), (0, 9999, "blocked_by")], "source_id bigint, target_id bigint, relation_type string")
    got = {r["id"]: (r["level"], r["finish"], r["tail"], r["slack"], r["critical"]) for r in schedule.schedule(tasks, edges, Scratch(spark)).collect()}
    assert got == {i: (level[i], into[i], out[i], most - (into[i] + out[i] - w), most == into[i] + out[i] - w) for i, w in weights.items()}
    with pytest.raises(ValueError, match="waits for itself"):
        schedule.schedule(tasks, spark.createDataFrame([(0, 100, "blocked_by"), (100, 0, "blocked_by")], edges.schema), Scratch(spark))


def test_reports_and_paired_runs(spark):
    judged = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1), ("q1", "c", 0), ("q2", "a", 0), ("q3", "x", 1)], "query_id string, doc_id string, relevance int")
    order = lambda rows: spark.createDataFrame(rows, "query_id string, doc_id string, rank int")
    good = order([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "a", 1), ("q3", "y", 1), ("q3", "x", 2)])
    bad = order([("q1", "c", 1), ("q1", "b", 2), ("q1", "a", 3), ("q2", "a", 1), ("q3", "x", 1)])
    ndcg = lambda df: {r["query_id"]: r["ndcg"] for r in evaluation.reranker_ndcg(df, judged).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert ndcg(good) == {"q1": pytest.approx(1.0), "q2": 0.0, "q3": pytest.approx(1 / math.log2(3))}
    assert ndcg(bad)["q1"] == pytest.approx((1 / math.log2(3) + 0.5) / ideal)
    rel = evaluation.relevant(judged)
    pair = {r["metric"]: r for r in evaluation.compare(evaluation.per_query(bad, rel, 2), evaluation.per_query(good, rel, 2)).collect()}
    d = [1.0 - 0.5, 0.0, 0.5 - 1.0]  # reciprocal ranks of q1, q2, q3
    assert (pair["rr"]["n"], pair["rr"]["wins"], pair["rr"]["losses"], pair["rr"]["ties"]) == (3, 1, 1, 1)
    assert pair["rr"]["difference"] == pytest.approx(statistics.mean(d)) and pair["rr"]["t"] == pytest.approx(statistics.mean(d) / (statistics.stdev(d) / 3**0.5))
    row = evaluation.report(good, rel, 2, "hand").first()
    assert (row["dataset"], row["queries"], row["k"], row["recall"], row["precision"]) == ("hand", 2, 2, pytest.approx(1.0), pytest.approx(3 / 5))
    lines = evaluation.report_text(evaluation.report(good, rel, 2, "hand")).first()["document"].split("\n")
    assert lines[:4] == ["=== Benchmark Report ===", "Dataset:      hand", "Queries:      2", "K:            2"] and "MRR:          0.7500" in lines


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    df = spark.createDataFrame([(0.8, "user", 100.0, 7, "two words"), (None, "x", None, None, ""), (2.0, "external", -1.0, 500, "é ü")], "c double, k string, h double, d bigint, t string")
    df.createOrReplaceTempView("rows_for_sql")
    got = [tuple(r) for r in spark.sql("SELECT trust_of(c, k, h), time_decay(h, 720D), centrality_of(d), token_estimate(t) FROM rows_for_sql").collect()]
    want = [tuple(r) for r in df.select(scoring.trust(F.col("c"), F.col("k"), F.col("h")), scoring.recency(F.col("h")), scoring.centrality(F.col("d")), text.token_count(F.col("t"))).collect()]
    near = lambda rows: [[None if x is None else round(x, 12) for x in r] for r in rows]
    assert near(got) == near(want)
    assert spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 1D)), cosine_similarity(array(1D), array(1D, 1D)), cosine_similarity(array(0D), array(1D))").first()[1:] == (0.0, 0.0)


def test_extractions_with_and_without_fences(spark):
    good = '{"entities": [{"id": "a", "category": "world", "content": "x", "relations": [{"target_id": "b", "relation_type": "next"}]}, {"id": "b"}]}'
    rows = [good, f"```json\n{good}\n```", f"```\n{good}```", '{"entities": []}', "no json", None, '{"other": 1}']
    got = [r["e"] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.parse_extraction(F.col("t"))["entities"].alias("e")).collect()]
    assert [None if e is None else [x["id"] for x in e] for e in got] == [["a", "b"], ["a", "b"], ["a", "b"], [], None, None, None]
    assert got[0][0]["relations"][0]["target_id"] == "b" and got[0][1]["content"] is None


def test_paths_of_a_walk_by_hand(spark):
    walked = spark.createDataFrame([(1, 0, None, None), (2, 1, 1, "x"), (3, 2, 2, "y"), (9, 0, None, None)], "id bigint, depth int, parent_id bigint, relation_type string")
    got = {r["id"]: (r["seed"], r["path"], r["relations"]) for r in explain.paths(walked).collect()}
    assert got == {1: (1, [1], []), 2: (1, [1, 2], ["x"]), 3: (1, [1, 2, 3], ["x", "y"]), 9: (9, [9], [])}


def test_unknown_nodes_have_no_breakdown_and_no_facts_a_whole_tree(spark):
    e = spark.createDataFrame([(1, "world", "alone", [1.0, 0.0], 0.0, 0.0, False)], "id bigint, category string, content string, embedding array<double>, age_hours double, created_hours double, archived boolean")
    none = spark.createDataFrame([], "source_id bigint, target_id bigint, relation_type string, weight double")
    assert explain.nodes(e, none, spark.createDataFrame([(7,)], "id bigint")).count() == 0
    assert explain.nodes(e, none).first()["score"] == pytest.approx(0.3)
    document = explain.explained(e, none, [1.0, 0.0], "q").first()["document"]
    assert "[1] depth=0 score=1.000" in document and "(no facts retrieved)" in document and document.endswith("Seeds: 1 | World: 0 | Opinion: 0 | Experience: 0 | Observation: 0\n")
