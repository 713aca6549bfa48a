"""The resilient worker: killed at different points, stopped and restarted, it gives the result of an undisturbed one."""

import pytest
from pyspark.sql import functions as F

from engram.sources.versions import Conflict, Store
from engram.streaming.worker import Worker

MESSAGE = "message_id bigint, dialog string"
TEXTS = ["he likes tea", "it is cold", "the sea is wide", "he likes tea a lot", "odd one", "it is not cold", "fresh", "late"]


def extract(df):
    """One fact a message; the embedding is one of eight axes by the topic, so equal topics match."""
    topic = F.when(F.col("dialog").contains("tea"), 0).when(F.col("dialog").contains("cold"), 1).otherwise(F.col("message_id") % 6 + 2)
    axis = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i == topic).cast("float"))
    category = F.when(F.col("dialog") == "odd one", "odd").otherwise("world")
    return df.select("message_id", (F.col("message_id") + 100).alias("id"), category.alias("category"), F.col("dialog").alias("content"), axis.alias("embedding"))


def source(spark, path):
    for i, t in enumerate(TEXTS):
        spark.createDataFrame([(i, t)], MESSAGE).coalesce(1).write.mode("append").json(path)


def state(store):
    e = {(r["id"], r["content"], r["archived"]) for r in store.read("entities").collect()}
    return e, {tuple(r)[:3] for r in store.read("edges").collect()}, {r["message_id"] for r in store.read("rejected").collect()}, sorted(r["message_id"] for r in store.read("ledger").collect())


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("messages"))
    source(spark, f"{at}/in")
    return f"{at}/in"


def run(spark, store, path, checkpoint, worker=None):
    w = worker or Worker(spark, store, MESSAGE, extract, in_flight=1)
    w.start(path, checkpoint, available_now=True).awaitTermination(120)
    return w


@pytest.fixture(scope="module")
def undisturbed(spark, path, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    store = Store(spark, f"{at}/s")
    w = run(spark, store, path, f"{at}/c")
    assert w.status().first()["processed"] == len(TEXTS)
    return state(store)


def test_every_message_has_its_effect(undisturbed):
    entities, edges, rejected, ledger = undisturbed
    contents = {c for _, c, archived in entities if not archived}
    assert ledger == list(range(len(TEXTS))) and rejected == {4}
    assert {"the sea is wide", "fresh", "late"} <= contents and any("tea a lot" in c for c in contents)


class Dies(Store):
    """Loses its driver before or right after the commits whose numbers are given."""

    def __init__(self, spark, path, before=(), after=()):
        self.before, self.after, self.count = set(before), set(after), 0
        super().__init__(spark, path)

    def _publish(self, version, text):
        self.count += 1
        if self.count in self.before:
            raise RuntimeError("driver lost")
        super()._publish(version, text)
        if self.count in self.after:
            raise RuntimeError("driver lost")


def test_killed_before_and_after_commits(spark, path, tmp_path, undisturbed):
    at, checkpoint = str(tmp_path / "s"), str(tmp_path / "c")
    for before, after in (((3,), ()), ((), (2,)), ((2,), ()), ((), (3,))):
        w = Worker(spark, Dies(spark, at, before, after), MESSAGE, extract, in_flight=1)
        with pytest.raises(Exception, match="driver lost"):
            run(spark, None, path, checkpoint, w)
    w = run(spark, Store(spark, at), path, checkpoint)
    assert state(w.store) == undisturbed and w.status().first()["processed"] == len(TEXTS)


def test_stopped_drained_and_restarted(spark, path, tmp_path, undisturbed):
    """What the source still holds waits in the pending table, in one batch: here the whole of it."""
    store = Store(spark, str(tmp_path / "s"))
    w = Worker(spark, store, MESSAGE, extract, in_flight=1)
    assert w.stop(path) == len(TEXTS) and w.stop(path) == len(TEXTS)  # draining twice drains once
    w.start(path, str(tmp_path / "c"), available_now=True).awaitTermination(120)
    assert store.read("pending").count() == 0 and w.stop(path) == 0
    entities, _, rejected, ledger = state(store)
    assert ledger == undisturbed[3] and rejected == undisturbed[2]
    assert w.status().first()["processed"] == len(TEXTS)


def test_a_repeated_batch_changes_nothing(spark, path, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    w = Worker(spark, store, MESSAGE, extract)
    batch = spark.createDataFrame([(1, "it is cold"), (1, "it is cold"), (None, "no id")], MESSAGE)
    assert w.apply(batch, 0) == 1
    before = state(store)
    assert w.apply(batch, 0) == 0 and state(store) == before


def test_two_workers_on_one_store_share_the_messages(spark, path, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a, b = (Worker(spark, store, MESSAGE, extract, worker_id=x) for x in "ab")
    batch = spark.createDataFrame([(1, "it is cold"), (2, "the sea")], MESSAGE)
    tx = store.begin()
    tx.append("ledger", spark.createDataFrame([(9, 9)], "message_id bigint, batch bigint"))
    assert a.apply(batch, 0) == 2 and b.apply(batch, 0) == 0
    with pytest.raises(Conflict):
        tx.commit()
    assert {r["worker_id"]: r["processed"] for r in a.status().collect()} == {"a": 2, "b": 0}
