"""Sinks, cycle checks, ranges, detectors and streams against plain Python."""

import itertools
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from engram.functions import text, times, vectors
from engram.operators import beliefs, episodic, graph, ranges, tasks, vector
from engram.sources.scratch import Scratch
from engram.streaming import ingest

EDGE = "source_id bigint, target_id bigint, relation_type string, weight double"


def edges(spark, pairs, relation="next"):
    return spark.createDataFrame([(a, b, relation, 1.0) for a, b in pairs], EDGE)


def reach(links, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in links:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_closing_edges_equal_a_search(spark):
    rng = random.Random(3)
    for _ in range(3):
        old = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(16)) if a < b}
        new = {(rng.randrange(14), rng.randrange(14)) for _ in range(6)}
        got = {(r["source_id"], r["target_id"]) for r in graph.closing(edges(spark, sorted(old)), edges(spark, sorted(new)), Scratch(spark)).collect()}
        assert got == {(a, b) for a, b in new if a in reach(old | new, b)}
    other = graph.closing(edges(spark, [(1, 2)]), edges(spark, [(2, 1)], "other"), Scratch(spark))
    assert other.count() == 0  # another relation closes nothing


def test_edge_sink_rejects_cycles(spark):
    n = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    kept, _, bad = graph.add_edges(n, edges(spark, [(0, 1), (1, 2)]), edges(spark, [(2, 0), (2, 3), (3, 3)]), ["next"], scratch=Scratch(spark))
    assert {(r["source_id"], r["target_id"]) for r in kept.collect()} == {(0, 1), (1, 2), (2, 3)}
    assert {(r["source_id"], r["target_id"]) for r in bad.collect()} == {(2, 0), (3, 3)}
    with pytest.raises(KeyError):
        graph.purge(n, edges(spark, []), spark.createDataFrame([(9,)], "id bigint"), strict=True)


def sequential_louvain(pairs, rounds=50):
    """Nodes in order, one at a time, over the whole graph; ties to the first community in order, as labels stand."""
    w = {}
    for a, b in pairs:
        w.setdefault(a, {}).setdefault(b, 0.0)
        w.setdefault(b, {}).setdefault(a, 0.0)
        w[a][b] += 1.0
        w[b][a] += 1.0
    order, m = sorted(w), float(len(pairs))
    own = {v: i for i, v in enumerate(order)}
    k = {v: sum(w[v].values()) for v in order}
    for _ in range(rounds):
        moved = False
        for v in order:
            best, top = own[v], 0.0
            for c in sorted({own[u] for u in w[v]}):
                if c != own[v]:
                    inside = sum(x for u, x in w[v].items() if own[u] == c)
                    gain = inside / m - k[v] * sum(k[u] for u in order if own[u] == c) / (2 * m * m)
                    if gain > top:
                        best, top = c, gain
            moved, own[v] = moved or best != own[v], best
        if not moved:
            break
    return {v: min(u for u in order if own[u] == own[v]) for v in order}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_louvain_equals_a_sequential_version(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(12 * part, 12 * part + 12), 2))) for part in range(2) for _ in range(24)})
    nodes = spark.createDataFrame([(i, False) for i in range(24)], "id bigint, archived boolean")
    got = {r["id"]: r["community"] for r in graph.louvain(graph.community_graph(nodes, edges(spark, pairs)), nodes, Scratch(spark)).collect()}
    assert got == {i: i for i in range(24)} | sequential_louvain(pairs)


def test_long_and_cyclic_recovery_chains(spark):
    plan = lambda e, start: [(r["step"], r["id"]) for r in tasks.recovery_plan(e, start, Scratch(spark)).orderBy("step").collect()]
    long = spark.range(5000).select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("recovers_via").alias("relation_type"))
    assert plan(long, 0) == [(i, i) for i in range(1, 5001)]
    assert plan(edges(spark, [(1, 2), (2, 3), (3, 1), (2, 9)], "recovers_via"), 1) == [(1, 2), (2, 3)]
    assert plan(edges(spark, [(1, 2), (2, 3), (3, 2)], "recovers_via"), 1) == [(1, 2), (2, 3)] and plan(edges(spark, [(1, 1)], "recovers_via"), 1) == []


def test_scratch_closes_what_it_owns(spark):
    there = lambda x: os.path.isdir(x.path.removeprefix("file://"))
    a, other = Scratch(spark), Scratch(spark)
    with a.owning():
        b = Scratch(spark)
        with b.owning():
            c = Scratch(spark)
    for x in (a, b, c, other):
        x.save(spark.range(3), "x")
    a.close_owned()
    assert not there(b) and not there(c) and spark.read.parquet(f"{a.path}/x").count() == 3 and there(other)
    a.close()
    assert not there(a) and there(other) and other.has("x") and not other.has("y")
    other.close()


def test_two_queries_on_two_threads_keep_their_tables(spark):
    """One closes what it owns while the other is at work."""
    ready, closed, out = threading.Event(), threading.Event(), {}

    def first():
        mine = Scratch(spark)
        with mine.owning():
            inner = Scratch(spark)
            inner.save(spark.range(5), "x")
            ready.wait(60)
            mine.close_owned()
        out["first"] = os.path.isdir(inner.path.removeprefix("file://"))
        closed.set()

    def second():
        theirs = Scratch(spark)
        kept = theirs.save(spark.range(7), "y")
        ready.set()
        closed.wait(60)
        out["second"] = kept.count()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out == {"first": False, "second": 7}


def test_named_scratch_is_found_again(spark):
    name = f"same-{os.getpid()}"
    a = Scratch(spark, name)
    a.save(spark.range(4), "x")
    b = Scratch(spark, name)
    assert b.has("x") and b.load("x").count() == 4
    b.close()
    assert not a.has("x")


def test_vectors_are_stored_removed_and_checked(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [0.0, 1.0], False), (3, None, False), (4, [1.0, 1.0], True)], "id bigint, embedding array<double>, archived boolean")
    assert [(r["id"], r["similarity"]) for r in vector.search_by_vector(e, [1.0, 0.0], 10**9).collect()] == [(1, 1.0), (2, 0.0)]
    for f in (vector.search, vector.search_by_vector):
        with pytest.raises(Exception, match="dimension mismatch"):
            f(e, [1.0, 0.0, 0.0]).collect()
    new = spark.createDataFrame([(3, [0.6, 0.8])], "id bigint, embedding array<double>")
    assert {r["id"] for r in vector.active(vector.store(e, new, 2)).collect()} == {1, 2, 3}
    assert {r["id"] for r in vector.active(vector.remove(e, new.select(F.lit(1).alias("id")))).collect()} == {2}


def test_sinks_of_tasks_beliefs_and_episodes(spark):
    t = spark.createDataFrame([(1, "pending", "task", 1, "a", False)], "id bigint, status string, category string, priority int, content string, archived boolean")
    rows = spark.createDataFrame([(2, "", "task", 1, "b", False), (3, "odd", "task", 1, "c", False), (4, "pending", "odd", 1, "d", False), (1, "pending", "task", 9, "z", False)], t.schema)
    made, bad = tasks.create(t, rows)
    assert sorted((r["id"], r["status"], r["content"]) for r in made.collect()) == [(1, "pending", "a"), (2, "pending", "b")] and {r["id"] for r in bad.collect()} == {3, 4}
    b = spark.createDataFrame([(1, "x", 0.5, "Active")], "id bigint, content string, confidence double, status string")
    made, bad = beliefs.create(b, spark.createDataFrame([(2, "y", 0.0, None), (3, " ", 0.5, None), (4, "w", 1.5, None)], b.schema))
    assert sorted((r["id"], r["confidence"], r["status"]) for r in made.collect()) == [(1, 0.5, "Active"), (2, 1.0, "Active")] and bad.count() == 2
    made = beliefs.update(made, spark.createDataFrame([(1, None, "Archived")], "id bigint, confidence double, status string"))
    assert sorted((r["id"], r["confidence"], r["status"]) for r in made.collect()) == [(1, 0.5, "Archived"), (2, 1.0, "Active")]
    left, proof = beliefs.delete(made, spark.createDataFrame([(1, "support"), (2, "refute")], "belief_id bigint, polarity string"), made.where("id = 1").select("id"))
    assert [r["id"] for r in left.collect()] == [2] and [r["belief_id"] for r in proof.collect()] == [2]
    ev = spark.createDataFrame([("e", 1, "message")], "episode_id string, id bigint, type string")
    got, bad = episodic.insert(ev, spark.createDataFrame([("e", 1, "action"), ("e", 2, "action"), ("e", 3, "odd")], ev.schema), ["episode_id", "id"], episodic.EVENT_TYPES)
    assert sorted((r["id"], r["type"]) for r in got.collect()) == [(1, "message"), (2, "action")] and bad.count() == 1


def test_interval_join_equals_pairs(spark):
    rng = random.Random(2)
    p = [(i, rng.randrange(-50, 300)) for i in range(120)]
    s = [(i, x, x + rng.choice([0, 1, 7, 40, 150])) for i, x in ((i, rng.randrange(-60, 300)) for i in range(40))]
    got = ranges.interval_join(spark.createDataFrame(p, "p bigint, at bigint"), spark.createDataFrame(s, "s bigint, a bigint, z bigint"), "at", "a", "z", 16)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((i, j) for (i, at), (j, a, z) in itertools.product(p, s) if a <= at < z)


def test_composite_detector_takes_the_last_that_finds(spark):
    rows = [(f, u, a, b) for f, u, a, b in itertools.product((True, False), repeat=4)]
    df = spark.createDataFrame(rows, "f boolean, u boolean, a boolean, b boolean")
    one, two, three = text.detection(F.col("f"), 0.3, "first", F.col("u")), text.detection(F.col("a"), 0.5, "a"), text.detection(F.col("b"), 0.9, "b")
    for r in df.select("*", text.compose(one, two, three).alias("x"), text.compose(one).alias("alone")).collect():
        want = ("b" if r["b"] else "a" if r["a"] else "") if r["f"] or r["u"] else ""
        assert (r["x"]["detected"], r["x"]["reason"]) == (want != "", want) and r["alone"]["detected"] == r["f"]
    m = spark.createDataFrame([((True, 0.0),), ((True, 0.7),), (None,)], "m struct<contradiction:boolean,confidence:double>").select(text.model_detection(F.col("m")).alias("x")).collect()
    assert [(r["x"]["detected"], r["x"]["confidence"]) for r in m] == [(True, 0.5), (True, 0.7), (False, 0.5)]


def test_times_and_codec(spark):
    rows = ["1970-01-01T00:00:00Z", "1970-01-01t01:00:00.250+01:00", "1970-01-01 00:00:00", "x", None, "2024-02-29T12:00:00.123456789Z"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(times.rfc3339_ms(F.col("t"))).collect()]
    assert got == [0, 250, None, None, None, 1709208000123]
    assert spark.range(1).select(times.ms_rfc3339(F.lit(0)), times.julian_ms(F.lit(2440587.5))).first()[:] == (None, 0)
    v = spark.createDataFrame([([0.0, 1.0, -2.0],), ([],)], "v array<double>").select(vectors.quantize(F.col("v")).alias("q"))
    back = v.select("q", vectors.bytes_quantized(F.col("q.min"), F.col("q.max"), vectors.quantized_bytes(F.col("q"))).alias("b")).collect()
    assert all(r["q"] == r["b"] for r in back)


def test_pending_messages_and_paired_streams(spark, tmp_path):
    ingest.drain(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string"), f"{tmp_path}/pending")
    assert sorted(r["id"] for r in ingest.undrained(spark, f"{tmp_path}/pending", "id bigint, text string").collect()) == [1, 2]
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "user string, t string").select("user", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/l")
    spark.createDataFrame([("u", "2024-01-01 00:30:00"), ("v", "2024-01-01 00:30:00")], "user string, t string").select("user", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/r")
    read = lambda x: spark.readStream.schema("user string, ts timestamp").parquet(f"{tmp_path}/{x}")
    q = ingest.paired(read("l"), read("r"), "user").select("user", "left_ts").writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["user"], str(r["left_ts"])) for r in spark.table("pairs").collect()] == [("u", "2024-01-01 00:00:00")]
