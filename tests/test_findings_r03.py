"""Findings of the third round: results on tables where ids meet, and steps that must not grow faster than the input."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram import catalogue
from engram.operators import beliefs, cycles, evaluation, graph, schedule, vector, vector_index
from engram.sources.scratch import Scratch
from engram.streaming import ingest
from tests.test_further import sequential_louvain

ENT = "id bigint, category string, content string, embedding array<float>, confidence double, archived boolean"


def test_created_beliefs_with_a_known_id_are_kept(spark):
    b = spark.createDataFrame([(1, "x", 0.5, "Active")], "id bigint, content string, confidence double, status string")
    made, bad = beliefs.create(b, spark.createDataFrame([(1, "y", 0.5, None), (2, "z", 0.5, None), (2, "w", 0.5, None), (3, " ", 0.5, None)], b.schema))
    assert sorted(r["content"] for r in made.collect()) == ["w", "x", "y", "z"] and [r["id"] for r in bad.collect()] == [3]


def test_an_ingested_row_matches_the_entity_it_names(spark):
    e = spark.createDataFrame([(1, "world", "tea", [1.0, 0.0], 0.9, False), (2, "world", "tea", [1.0, 0.0], 0.9, False), (3, "world", "tea", [1.0, 0.0], 0.9, True), (4, "world", "tea", [0.0, 1.0], 0.9, False)], ENT)
    new = spark.createDataFrame([(10 + i, "world", f"n{i}", [1.0, 0.0], a) for i, a in enumerate((2, 3, 4, None))], "id bigint, category string, content string, embedding array<float>, about bigint")
    changes, _, _ = ingest.ingest_batch(e, new)
    got = sorted((r["id"], r["content"], r["action"]) for r in changes.collect())
    assert got == [(2, "tea; n0", "merge"), (11, "n1", "create"), (12, "n2", "create"), (13, "n3", "create")]
    assert {r["action"] for r in ingest.ingest_batch(e, new.drop("about"))[0].select(F.col("action")).collect()} == {"merge"}


def test_judgements_by_label_count_as_all_their_pairs(spark):
    q = spark.createDataFrame([(1, 0), (2, 1), (3, 7), (4, None)], "query_id bigint, label int")
    docs = spark.createDataFrame([(i, i % 3 if i % 5 else None, i % 2) for i in range(30)], "doc_id bigint, label int, relevance int")
    results = spark.createDataFrame([(a, (a * 7 + r * 4) % 33, r) for a in (1, 2, 3, 4, 9) for r in (1, 2, 3, 4)], "query_id bigint, doc_id bigint, rank int")
    graded = evaluation.Labels(q, docs)
    pairs, labels = evaluation.relevant(graded.pairs()), evaluation.relevant(graded)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for f in (lambda j: evaluation.precision_recall(results, j, 3), lambda j: evaluation.mrr(results, j), lambda j: evaluation.ndcg(results, j, 3), lambda j: evaluation.per_query(results, j, 3), lambda j: evaluation.report(results, j, 3, "x")):
        assert rows(f(pairs)) == rows(f(labels))
    assert rows(evaluation.reranker_ndcg(results, graded.pairs())) == rows(evaluation.reranker_ndcg(results, graded))


def test_registered_evaluations_join_no_pairs_of_a_label(spark, sf):
    results, judged = catalogue._judged(spark, sf)
    assert isinstance(judged, evaluation.Labels) and results.count() == 250


def test_a_search_task_keeps_its_best_only(spark, monkeypatch):
    monkeypatch.setattr(vector, "CELLS", 64)
    rng = np.random.default_rng(3)
    points = rng.integers(-2, 3, (300, 4)).astype(float)
    e = spark.createDataFrame([(i, p.tolist(), False) for i, p in enumerate(points)], "id bigint, embedding array<double>, archived boolean").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        found = vector._best(e, list(range(20)), vector.unit(points[:20]), 5, "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sim = np.round(vector.unit(points[:20]) @ vector.unit(points).T, 6)
    want = {(i, int(j)) for i in range(20) for j in np.lexsort((np.arange(300), -sim[i]))[:5]}
    assert len(found) == 100 and {(r["query_id"], r["id"]) for r in found} == want


def test_candidates_hold_the_kth_ties_and_not_a_number():
    x = np.array([[1.0, 0.0]])
    y = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [np.nan, 0.0], [1.0, 0.0]])
    i, j, sim = vector.candidates(x, y, np.array([-np.inf]), 3)
    assert set(j) >= {0, 2, 3, 4} and list(j[vector.best_of(i, j, sim, 3)]) == [3, 0, 2]


def test_texts_do_not_enter_the_join_of_contradictions(spark, sf):
    plan = catalogue.QUERIES["lexical_contradiction_stemmed"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "text#" not in plan and "stem_marks(" not in plan


def test_sketches_are_made_by_flag_and_not_by_value(spark, sf):
    plan = catalogue.QUERIES["approx_distinct"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert all("l_partkey" not in x.split("functions=")[0] for x in plan.split("\n") if "approx_count_distinct" in x)


def test_small_lists_share_blocks(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(400, 8))
    e = spark.createDataFrame([(i, p.tolist(), False) for i, p in enumerate(points)], "id bigint, embedding array<double>, archived boolean")
    scratch = Scratch(spark)
    for lists, block in ((20, 100), (3, 50)):
        index = vector_index.fit(e, 8, scratch, lists=lists, block=block)
        first, pieces = vector_index.packed(index)
        assert (first + pieces).max() <= 2 * 400 / block + len(index.sizes[index.sizes > block])
        got = {(r["a"], r["b"]): r["similarity"] for r in vector_index.similar(index, 0.5).collect()}
        assert got == {(r["a"], r["b"]): r["similarity"] for r in vector.block_pairs(e, 0.5).collect()}


class Counting(Scratch):
    """Counts the rows of every table written."""

    def __init__(self, spark):
        super().__init__(spark)
        self.rows = []

    def save(self, df, name):
        out = super().save(df, name)
        self.rows.append(out.count())
        return out


TASK_EDGE = "source_id bigint, target_id bigint, relation_type string"


def test_a_schedule_follows_chains_in_few_tables(spark):
    """A fork, two long chains and a join: rounds were as many as the links, each with all tasks twice."""
    n = 60
    links = [(0, 1), (0, 1001), *((i, i + 1) for i in range(1, n)), *((1000 + i, 1001 + i) for i in range(1, n - 10)), (n, 5000), (990 + n, 5000), (5000, 5001)]
    ids = sorted({x for e in links for x in e})
    scratch = Counting(spark)
    tasks = spark.createDataFrame([(i, 1) for i in ids], "id bigint, weight bigint")
    edges = spark.createDataFrame([(a, b, "blocked_by") for a, b in links], TASK_EDGE)
    got = {r["id"]: (r["level"], r["finish"], r["tail"], r["slack"]) for r in schedule.schedule(tasks, edges, scratch).collect()}
    want = {0: (0, 1, n + 3, 0), n: (n, n + 1, 3, 0), 1001: (1, 2, n - 8, 10), 5001: (n + 2, n + 3, 1, 0)}
    assert {i: got[i] for i in want} == want and len(got) == len(ids)
    assert len(scratch.rows) < 30 and sum(scratch.rows) < 14 * len(ids)


@pytest.mark.parametrize("kind,step", [("bigint", 1), ("double", 0.25)])
def test_schedules_with_negative_weights(spark, kind, step):
    rng, weights, links = random.Random(8), {}, set()
    for g in range(8):
        ids = [100 * g + i for i in range(rng.randint(2, 14))]
        weights |= {i: step * rng.randint(-6, 9) for i in ids}
        links |= {(a, b) for a, b in zip(ids, ids[1:], strict=False) if rng.random() < 0.8} | {(a, b) for a in ids for b in ids if a < b and rng.random() < 0.08}
    level, into, out = {}, {}, {}
    for i in sorted(weights):
        above = [a for a, b in links if b == i]
        level[i], into[i] = 1 + max((level[a] for a in above), default=-1), weights[i] + max([into[a] for a in above] + [0])
    for i in sorted(weights, reverse=True):
        out[i] = weights[i] + max([out[b] for a, b in links if a == i] + [0])
    tasks = spark.createDataFrame(list(weights.items()), f"id bigint, weight {kind}")
    edges = spark.createDataFrame([(a, b, "blocked_by") for a, b in links], TASK_EDGE)
    got = {r["id"]: (r["level"], r["finish"], r["tail"], r["slack"]) for r in schedule.schedule(tasks, edges, Scratch(spark)).collect()}
    assert got == {i: (level[i], into[i], out[i], max(into.values()) - (into[i] + out[i] - w)) for i, w in weights.items()}


@pytest.mark.parametrize("links", [[(1, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 2), (3, 4)], [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)]])
def test_schedules_name_a_task_on_a_cycle(spark, links):
    tasks = spark.createDataFrame([(i, 1) for i in range(6)], "id bigint, weight int")
    with pytest.raises(ValueError, match="task [1-4] waits for itself"):
        schedule.schedule(tasks, spark.createDataFrame([(a, b, "blocked_by") for a, b in links], TASK_EDGE), Scratch(spark))


@pytest.mark.parametrize("sweeps", [1, 3, 50, 1_000_000, 1_000_002])
def test_sweeps_that_come_round_are_not_run(spark, sweeps):
    """Nodes leave for the best other community even if staying is better: on a path of 12 labels turn in fives."""
    pairs = [(i, i + 1) for i in range(11)]
    rounds = sweeps if sweeps < 100 else 100 + sweeps % 5
    want = sequential_louvain(pairs, rounds)
    assert rounds < 100 or want == sequential_louvain(pairs, rounds - 5) != sequential_louvain(pairs, rounds - 1)
    nodes = spark.createDataFrame([(i, False) for i in range(12)], "id bigint, archived boolean")
    edges = spark.createDataFrame([(a, b, "next", 1.0) for a, b in pairs], "source_id bigint, target_id bigint, relation_type string, weight double")
    got = graph.louvain(graph.community_graph(nodes, edges), nodes, Scratch(spark), sweeps).collect()
    assert {r["id"]: r["community"] for r in got} == want


def test_a_cycle_check_reads_the_relations_of_the_new_edges_only(spark):
    """Chains of another relation doubled their pointers as well, and ids travelled in pairs with their relation."""
    chain = [(i, i + 1, "next") for i in range(200)]
    old = spark.createDataFrame([*chain, *((i, i + 1, "other") for i in range(3000)), (5, 4, None), (900, 901, "b")], TASK_EDGE)
    scratch = Counting(spark)
    new = spark.createDataFrame([(200, 0, "next"), (200, 300, "next"), (None, 1, "next")], TASK_EDGE)
    assert [tuple(r) for r in cycles.closing(old, new, scratch).collect()] == [(200, 0, "next")]
    assert sum(scratch.rows) < 6000
    mixed = spark.createDataFrame([(200, 0, "next"), (901, 900, "b"), (4, 5, None), (1, 0, "b"), (7, 7, "c")], TASK_EDGE)
    assert {tuple(r) for r in cycles.closing(old, mixed, Scratch(spark)).collect()} == {(200, 0, "next"), (901, 900, "b"), (4, 5, None), (7, 7, "c")}
    alone = mixed.where("relation_type is null")
    assert [tuple(r) for r in cycles.closing(old, alone, Scratch(spark)).collect()] == [(4, 5, None)]
