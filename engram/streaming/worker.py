"""A dialog worker that can be killed at any point and gives the result of an undisturbed one.

Every micro-batch is one commit to a versioned store: the changed entities, the contradiction edges, the rejected rows, the
ledger of message ids and the checkpoint row become visible together or not at all. A batch that the stream repeats after a
crash finds its messages in the ledger and changes nothing. ``stop`` ends the stream between batches and drains what the
source still holds into the table of pending messages; the next ``start`` processes those first.

Bounds: a micro-batch takes at most ``in_flight`` files of the source. Messages of one batch are matched against the state
before it. State is read as the newest row of each key, and a commit writes only what changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.functions.text import lexical_contradiction, resolve
from engram.schema import Vocabulary
from engram.sources.versions import Store, Transaction
from engram.streaming.ingest import ingest_batch

ENTITY = "id bigint, category string, content string, embedding array<float>, confidence double, archived boolean"
EDGE = "source_id bigint, target_id bigint, relation_type string, weight double"
REJECTED = "message_id bigint, id bigint, category string, content string"
CHECKPOINT = "worker_id string, last_batch bigint, processed bigint, committed_at timestamp"


class Worker:
    """``extract`` turns messages into ``(message_id, id, category, content, embedding)``; message columns are ``schema``,
    of which ``message_id`` is one."""

    def __init__(self, spark: SparkSession, store: Store, schema: str, extract: Callable[[DataFrame], DataFrame], worker_id: str = "worker", in_flight: int = 8, threshold: float = 0.88, vocabulary: Vocabulary | None = None, detect: Callable[[Column, Column], Column] = lexical_contradiction, resolver: Callable[[Column], Column] = resolve):
        self.spark, self.store, self.schema, self.extract = spark, store, schema, extract
        self.worker_id, self.in_flight, self.threshold = worker_id, in_flight, threshold
        self.vocabulary, self.detect, self.resolver = vocabulary or Vocabulary(), detect, resolver
        self.query: StreamingQuery | None = None
        empty = lambda schema: spark.createDataFrame([], schema)

        def tables(tx: Transaction) -> None:
            for name, kind, key in (("entities", ENTITY, ["id"]), ("edges", EDGE, ["source_id", "target_id", "relation_type"]), ("rejected", REJECTED, []), ("ledger", "message_id bigint, batch bigint", []), ("pending", schema, []), ("checkpoint", CHECKPOINT, ["worker_id"])):
                if not tx.has(name):
                    tx.create(name, empty(kind), key)

        store.update(tables)

    def messages(self, path: str) -> DataFrame:
        """JSON lines of a folder as a stream, at most ``in_flight`` files a batch."""
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.in_flight).json(path)

    def apply(self, messages: DataFrame, batch: int, clear_pending: bool = False) -> int:
        """One batch as one commit; the number of messages that were new."""

        def change(tx: Transaction) -> int:
            fresh = messages.where("message_id is not null").dropDuplicates(["message_id"]).join(tx.read("ledger").select("message_id"), "message_id", "left_anti")
            tx.append("ledger", fresh.select("message_id", F.lit(batch).cast("long").alias("batch")))
            taken = messages.join(self._written(tx, "ledger"), "message_id", "left_semi").dropDuplicates(["message_id"])
            n = self._written(tx, "ledger").count()
            if clear_pending:
                tx.replace("pending", tx.read("pending").limit(0))
            if n:
                self._change(tx, self.extract(taken))
            before = tx.read("checkpoint").where(F.col("worker_id") == self.worker_id).first()
            now = [(self.worker_id, batch, (before["processed"] if before else 0) + n)]
            tx.upsert("checkpoint", self.spark.createDataFrame(now, "worker_id string, last_batch bigint, processed bigint").withColumn("committed_at", F.current_timestamp()))
            return n

        return self.store.update(change)

    def _written(self, tx: Transaction, name: str) -> DataFrame:
        """The rows that this transaction has added to a table."""
        folder, _ = tx.now[name].folders[-1]
        return self.spark.read.parquet(f"{self.store.path}/{folder}")

    def _change(self, tx: Transaction, incoming: DataFrame) -> None:
        entities = tx.read("entities")
        columns = entities.columns
        changes, links, rejected = ingest_batch(entities, incoming.drop("message_id"), self.vocabulary, self.threshold, self.detect, self.resolver)
        old = entities.select("id", "confidence", F.col("embedding").alias("_old"))
        new = changes.join(old, "id", "left").select("id", "category", "content", F.coalesce("_old", "embedding").alias("embedding"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit(False).alias("archived"), (F.col("action") == "merge").alias("_merge"))
        archived = entities.join(changes.where("archives is not null").select(F.col("archives").alias("id")).distinct(), "id", "left_semi").withColumn("archived", F.lit(True))
        # several merges into one entity: their contents in order; a fresh row has an id of its own
        one = new.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("content")), "; ").alias("content"), *[F.min_by(c, "content").alias(c) for c in columns if c not in ("id", "content")])
        tx.upsert("entities", one.select(*columns).unionByName(archived.join(one.select("id"), "id", "left_anti").select(*columns)))
        tx.upsert("edges", links)
        by_id = incoming.select("id", "message_id").dropDuplicates(["id"])
        tx.append("rejected", rejected.join(by_id, "id", "left").select("message_id", "id", "category", "content"))

    def start(self, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Pending messages first, then the stream of ``path``."""
        pending = self.store.read("pending")
        if not pending.isEmpty():
            self.apply(pending, -1, clear_pending=True)
        writer = self.messages(path).writeStream.foreachBatch(lambda df, i: self.apply(df, i)).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        return self.query

    def stop(self, path: str) -> int:
        """Ends the stream between two batches and drains the source: what is not in the ledger goes to the pending table in
        one commit; the number of messages there."""
        if self.query is not None:
            self.query.stop()
        left = self.spark.read.schema(self.schema).json(path)

        def change(tx: Transaction) -> None:
            todo = left.where("message_id is not null").dropDuplicates(["message_id"]).join(tx.read("ledger").select("message_id"), "message_id", "left_anti")
            tx.replace("pending", todo)

        self.store.update(change)
        return self.store.read("pending").count()

    def status(self) -> DataFrame:
        """The checkpoint of each worker of the store."""
        return self.store.read("checkpoint")
