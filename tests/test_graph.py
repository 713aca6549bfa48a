"""Graph, task and clustering operators on small fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from engram.operators import graph, maintenance, tasks
from engram.sources.scratch import Scratch

EDGE = "source_id bigint, target_id bigint, relation_type string, weight double"
ENTITY = "id bigint, category string, content string, archived boolean"
TASK = "id bigint, category string, status string, priority int, content string, archived boolean"


def edges(spark, pairs, kind="next"):
    return spark.createDataFrame([(a, b, kind, 1.0) for a, b in pairs], EDGE)


def nodes(spark, ids, archived=()):
    return spark.createDataFrame([(i, "world", f"n{i}", i in archived) for i in ids], ENTITY)


def task_rows(spark, rows):
    return spark.createDataFrame([(i, "task", s, 0, f"t{i}", False) for i, s in rows], TASK)


def test_star_component(spark):
    r = graph.components(nodes(spark, [1, 2, 3, 4]), edges(spark, [(1, 2), (1, 3), (1, 4)]), Scratch(spark)).collect()
    assert [(x["component"], x["size"], x["avg_degree"]) for x in r] == [(1, 4, 1.5)]


def test_component_reaches_archived_but_archived_alone_starts_none(spark):
    r = graph.components(nodes(spark, [1, 2, 9], archived=(2, 9)), edges(spark, [(1, 2)]), Scratch(spark)).collect()
    assert [(x["component"], x["size"]) for x in r] == [(1, 2)]


def test_min_size_filters_components(spark):
    r = graph.components(nodes(spark, [1, 2, 3]), edges(spark, [(1, 2)]), Scratch(spark), min_size=2).collect()
    assert [x["size"] for x in r] == [2]


def test_long_chain_and_hub_settle(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)]
    r = {x["component"]: x["size"] for x in graph.components(nodes(spark, [*range(1, 60), *range(100, 161)]), edges(spark, chain), Scratch(spark)).collect()}
    assert r == {1: 59, 100: 61}


def test_self_loop_counts_twice(spark):
    assert graph.degree(edges(spark, [(1, 1)])).first()["degree"] == 2


def test_walk_prefers_short_then_light(spark):
    e = spark.createDataFrame([(1, 2, "x", 5.0), (1, 3, "x", 1.0), (3, 2, "x", 1.0), (3, 4, "x", 1.0), (2, 4, "x", 0.1)], EDGE)
    r = {x["id"]: (x["depth"], x["path_weight"], x["parent_id"]) for x in graph.walk(nodes(spark, [1, 2, 3, 4]), e, spark.createDataFrame([(1,)], "id bigint")).collect()}
    assert r == {1: (0, 0.0, None), 2: (1, 5.0, 1), 3: (1, 1.0, 1), 4: (2, 2.0, 3)}


def test_walk_skips_archived_and_caps_depth(spark):
    e = edges(spark, [(i, i + 1) for i in range(1, 10)])
    n = nodes(spark, range(1, 11), archived=(3,))
    seed = spark.createDataFrame([(1,)], "id bigint")
    assert {x["id"] for x in graph.walk(n, e, seed, 5).collect()} == {1, 2}
    assert {x["id"] for x in graph.walk(nodes(spark, range(1, 11)), e, seed, 9).collect()} == {1, 2, 3, 4, 5, 6}


def test_closure_ends_on_a_cycle(spark):
    r = graph.closure(edges(spark, [(1, 2), (2, 3), (3, 1)]), spark.createDataFrame([(1,)], "id bigint"), Scratch(spark)).collect()
    assert {(x["id"], x["depth"]) for x in r} == {(1, 0), (2, 1), (3, 2)}
    assert graph.reaches(edges(spark, [(1, 2), (2, 3)]), 1, 3, "next", Scratch(spark))
    assert not graph.reaches(edges(spark, [(1, 2)]), 2, 1, "next", Scratch(spark))


@pytest.mark.parametrize("pairs,groups", [([(1, 2), (2, 3), (1, 3), (4, 5)], {frozenset({1, 2, 3}), frozenset({4, 5})}), ([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)], {frozenset({1, 2, 3}), frozenset({4, 5, 6})})])
def test_louvain_partitions(spark, pairs, groups):
    ids = sorted({x for p in pairs for x in p})
    n = nodes(spark, ids)
    g = graph.community_graph(n, edges(spark, pairs))
    labels = graph.louvain(g, n, Scratch(spark))
    found = {}
    for x in labels.collect():
        found.setdefault(x["community"], set()).add(x["id"])
    assert sorted(x for v in found.values() for x in v) == ids  # a partition, within connected parts
    assert all(any(v <= g for g in groups) for v in found.values())
    assert -0.5 <= graph.modularity(g, labels).first()["modularity"] <= 1


def test_distributed_moves_find_two_triangles(spark):
    ids, pairs = [1, 2, 3, 4, 5, 6, 9], [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    n = nodes(spark, ids)
    g = graph.community_graph(n, edges(spark, pairs))
    labels = graph.local_moves(g, n, Scratch(spark))
    assert {x["id"]: x["community"] for x in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 9: 9}
    assert graph.local_moves(graph.community_graph(n, edges(spark, [])), n, Scratch(spark)).count() == 7


def test_single_node_is_its_own_community_and_empty_graph_has_none(spark):
    n = nodes(spark, [7])
    g = graph.community_graph(n, edges(spark, []))
    assert [(x["id"], x["community"]) for x in graph.louvain(g, n, Scratch(spark)).collect()] == [(7, 7)]
    assert graph.louvain(g, nodes(spark, []), Scratch(spark)).count() == 0
    assert graph.modularity(g, n.select("id", F.col("id").alias("community"))).first()["modularity"] == 0.0


def test_edge_sink_rejects_unknown_relation_and_missing_ends(spark):
    e, n, bad = graph.add_edges(nodes(spark, [1, 2]), edges(spark, []), spark.createDataFrame([(1, 2, "next", 0.0), (1, 2, "next", 3.0), (1, 9, "next", 1.0), (1, 2, "odd", 1.0)], EDGE), ["next"])
    assert e.count() == 1 and n.count() == 2
    assert {(x["target_id"], x["relation_type"]) for x in bad.collect()} == {(9, "next"), (2, "odd")}
    e, n, bad = graph.add_edges(nodes(spark, [1]), edges(spark, []), edges(spark, [(1, 9)]), ["next"], create_missing=True)
    assert e.count() == 1 and n.count() == 2 and bad.count() == 0


def test_purge_and_orphans(spark):
    n, e = graph.purge(nodes(spark, [1, 2, 3]), edges(spark, [(1, 2), (2, 3), (1, 3)]), spark.createDataFrame([(2,)], "id bigint"))
    assert {x["id"] for x in n.collect()} == {1, 3} and [(x["source_id"], x["target_id"]) for x in e.collect()] == [(1, 3)]
    o = graph.orphan_edges(n, edges(spark, [(1, 2)])).first()
    assert (o["missing_source"], o["missing_target"]) == (False, True)


def test_blocking_direction_and_null_status(spark):
    t = task_rows(spark, [(1, "pending"), (2, "pending"), (3, None), (4, "pending")])
    e = spark.createDataFrame([(1, 2, "blocked_by"), (3, 4, "blocked_by"), (2, 1, "recovers_via")], "source_id bigint, target_id bigint, relation_type string")
    assert {x["id"] for x in tasks.executable(t, e).collect()} == {1, 4}  # a blocker without status does not block
    assert {(x["role"], x["source_id"], x["target_id"]) for x in tasks.relations(e, 2).collect()} == {("blocked_by", 1, 2), ("recovers_via", 2, 1)}
    assert {x["id"] for x in tasks.roots(t, e).collect()} == {1, 3}


def test_task_tree_and_cycle_leaf(spark):
    t = task_rows(spark, [(1, "pending"), (2, "pending"), (3, "pending")])
    e = spark.createDataFrame([(2, 1, "blocked_by"), (3, 2, "blocked_by"), (1, 3, "blocked_by")], "source_id bigint, target_id bigint, relation_type string")
    assert tasks.tree(t, e, 1, Scratch(spark)) == [(0, 1, "t1"), (1, 2, "t2"), (2, 3, "t3"), (3, 1, "t1 (cycle)")]


def test_recovery_chain_stops_at_cycle(spark):
    e = spark.createDataFrame([(1, 2, "recovers_via"), (2, 3, "recovers_via"), (3, 1, "recovers_via")], "source_id bigint, target_id bigint, relation_type string")
    assert [x["id"] for x in tasks.recovery_plan(e, 1, Scratch(spark)).orderBy("step").collect()] == [2, 3]
    assert tasks.recovery_plan(e, 9, Scratch(spark)).count() == 0


def test_rollback_prunes_done_and_limits(spark):
    t = task_rows(spark, [(1, "in_progress"), (2, "completed"), (3, "pending"), (4, "pending")])
    e = spark.createDataFrame([(1, 2, "blocked_by"), (2, 3, "blocked_by"), (1, 4, "blocked_by"), (4, 1, "blocked_by")], "source_id bigint, target_id bigint, relation_type string")
    start = spark.createDataFrame([(1,)], "id bigint")
    r = {x["id"]: x["content"] for x in tasks.cascade_rollback(t, e, start, Scratch(spark), "boom").collect()}
    assert r == {1: "t1\n[ROLLBACK: boom]", 4: "t4\n[ROLLBACK: boom]"}
    with pytest.raises(RuntimeError):
        tasks.cascade_rollback(t, e, start, Scratch(spark), limit=1)


def test_status_and_transitions(spark):
    t = task_rows(spark, [(1, "pending")])
    with pytest.raises(ValueError):
        tasks.set_status(t, t, "odd")
    assert tasks.set_status(t, t, "completed").first()["status"] == "completed"
    r = spark.createDataFrame([("pending", "in_progress"), ("pending", "completed"), ("completed", "in_progress"), ("odd", "pending"), (None, "pending")], "a string, b string").select(tasks.transition_allowed(F.col("a"), F.col("b")).alias("x")).collect()
    assert [x["x"] for x in r] == [True, False, True, False, False]


def test_agent_loop_runs_in_dependency_order(spark):
    done = []
    t = spark.createDataFrame([(1, "task", "pending", 0, "a", False), (2, "task", "pending", 9, "b", False)], TASK)
    e = spark.createDataFrame([(1, 2, "blocked_by")], "source_id bigint, target_id bigint, relation_type string")
    tasks.agent_loop(t, e, lambda i, c: done.append(i) or "completed", Scratch(spark))
    assert done == [1, 2]


def test_greedy_clusters_equal_the_sequential_pass(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v[i]], False) for i in range(60)]
    e = spark.createDataFrame(rows, "id bigint, embedding array<float>, archived boolean")
    f = np.array([[np.float32(x) for x in r] for r in v], np.float64)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    free, want = list(range(60)), set()
    while free:
        seed = free[0]
        got = [seed] + [j for j in free[1:] if round(float(f[seed] @ f[j]), 6) >= 0.75]
        free = [j for j in free if j not in got]
        if len(got) >= 2:
            want |= {(seed, j) for j in got[:10]}
    assert {(x["cluster"], x["id"]) for x in maintenance.greedy_clusters(e, Scratch(spark)).collect()} == want
