"""Versioned tables: conflicts, pinned readers, crashes before the commit, claims from several threads, whole batches."""

import threading

import pytest
from pyspark.sql import functions as F

from engram.operators import claims
from engram.sources.versions import Conflict, Store

ROW = "id bigint, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commits_conflicts_and_pinned_readers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.tables() == []
    make = lambda *x: spark.createDataFrame(list(x), ROW)
    store.update(lambda tx: (tx.create("a", make((1, "x"), (2, "y")), ["id"]), tx.create("log", make((0, "start")))))
    pinned = store.read("a")
    one, two = store.begin(), store.begin()
    one.upsert("a", make((2, "z"), (3, "w"), (3, "w")))
    one.append("log", make((1, "one")))
    assert rows(one.read("a")) == [(1, "x"), (2, "z"), (3, "w")] and rows(store.read("a")) == [(1, "x"), (2, "y")]
    two.delete("a", make((1, "")))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    assert rows(pinned) == [(1, "x"), (2, "y")] and rows(store.read("a", 1)) == [(1, "x"), (2, "y")]
    assert rows(store.read("a")) == [(1, "x"), (2, "z"), (3, "w")] and rows(store.read("log")) == [(0, "start"), (1, "one")]
    store.update(lambda tx: tx.delete("a", make((1, ""))))
    assert rows(store.read("a")) == [(2, "z"), (3, "w")]
    store.update(lambda tx: tx.upsert("a", make((1, "back"))))
    store.compact("a")
    assert rows(store.read("a")) == [(1, "back"), (2, "z"), (3, "w")] and len(store.manifest(store.version())["a"].folders) == 1
    with pytest.raises(ValueError):
        store.begin().append("a", make((9, "")))
    assert store.begin().commit() == store.version()  # nothing changed, no new version


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.update(lambda tx: tx.create("a", spark.createDataFrame([(1, "x")], ROW), ["id"]))

    def dies(tx):
        tx.upsert("a", spark.createDataFrame([(1, "half")], ROW))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.update(dies)
    again = Store(spark, str(tmp_path / "s"))
    assert again.version() == 1 and rows(again.read("a")) == [(1, "x")]
    for i in range(4):
        again.update(lambda tx, i=i: tx.upsert("a", spark.createDataFrame([(1, str(i))], ROW)))
    again.compact("a")
    assert again.vacuum(keep=1) >= 1 and rows(again.read("a")) == [(1, "3")] and again.versions() == [again.version()]


TASK = "id bigint, status string, category string, priority int, content string, archived boolean"
EDGE = "source_id bigint, target_id bigint, relation_type string, weight double"


def graph(spark, n=12):
    t = [(i, "pending", "task", i % 3, f"t{i}", i == 5) for i in range(n)]
    return spark.createDataFrame(t, TASK), spark.createDataFrame([(0, 1, "blocked_by", 1.0), (1, 2, "blocked_by", 1.0)], EDGE)


def test_threads_never_claim_one_task_twice(spark, tmp_path):
    claims.put(Store(spark, str(tmp_path / "s")), *graph(spark))
    taken, lock, errors = [], threading.Lock(), []

    def worker():
        try:
            mine = Store(spark, str(tmp_path / "s"))
            while got := [r["id"] for r in claims.claim_next(mine, 2).collect()]:
                with lock:
                    taken.extend(got)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=worker) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(taken) == [0, 3, 4, 6, 7, 8, 9, 10, 11]
    assert {r["id"] for r in Store(spark, str(tmp_path / "s")).read("tasks").where("status = 'in_progress'").collect()} == set(taken)


def test_claims_go_by_priority_within_a_goal_and_states_by_steps(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    claims.put(store, *graph(spark))
    goal = spark.createDataFrame([(3,), (2,), (8,), (5,)], "id bigint")
    assert [r["id"] for r in claims.claim_next(store, 1, within=goal).collect()] == [8]
    assert [r["id"] for r in claims.claim_next(store, 9, within=goal).collect()] == [3]
    eight = spark.createDataFrame([(8,)], "id bigint")
    claims.set_status(store, eight, "completed")
    for bad in ("pending", "odd"):
        with pytest.raises(ValueError):
            claims.set_status(store, eight, bad)
    assert store.read("tasks").where("id = 8").first()["status"] == "completed"


def test_agents_finish_a_chain_and_give_back_what_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    claims.put(store, *graph(spark, 5))
    ran = []
    assert claims.run_agent(store, lambda i, c: ran.append((i, c)) or "completed") == 5
    assert [i for i, _ in ran if i in (0, 1, 2)] == [0, 1, 2] and set(store.read("tasks").select("status").distinct().collect()) == {("completed",)}
    other = Store(spark, str(tmp_path / "o"))
    claims.put(other, *graph(spark, 4))

    def fails(i, c):
        if i == 0:
            raise RuntimeError("no")
        return "completed"

    with pytest.raises(RuntimeError, match="no"):
        claims.run_agent(other, fails)
    assert {r["id"]: r["status"] for r in other.read("tasks").collect()} == {0: "pending", 1: "pending", 2: "pending", 3: "completed"}


def test_episode_batches_are_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    s = spark.createDataFrame([("s1",)], "session_id string")
    e = spark.createDataFrame([("e1", "s1"), ("e2", "s1")], "episode_id string, session_id string")
    ev = lambda *x: spark.createDataFrame(list(x), "id bigint, episode_id string, type string")
    types = ("message", "action")
    assert claims.insert_episodes(store, s, e, ev((1, "e1", "message"), (2, "e2", "action")), types) == 1
    for bad in (ev((3, "e1", "message"), (4, "e1", "odd")), ev((3, "e9", "message"))):
        with pytest.raises(ValueError):
            claims.insert_episodes(store, s, e, bad, types)
    with pytest.raises(ValueError):
        claims.insert_episodes(store, s.limit(0), e.limit(0).union(spark.createDataFrame([("e7", "s7")], e.schema)), ev((3, "e1", "message")), types)
    assert store.version() == 1 and store.read("events").count() == 2
    claims.insert_episodes(store, s, e, ev((2, "e1", "message"), (5, "e2", "message")), types)
    assert rows(store.read("events")) == [(1, "e1", "message"), (2, "e2", "action"), (5, "e2", "message")]
    assert store.read("episodes").agg(F.count("*")).first()[0] == 2
