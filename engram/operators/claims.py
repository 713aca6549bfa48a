"""Tasks in a versioned store: claims that are safe for any number of drivers, and batches written all or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators import tasks
from engram.operators.tasks import V
from engram.schema import Vocabulary
from engram.sources.versions import Store

TASKS, EDGES = "tasks", "task_edges"


def put(store: Store, rows: DataFrame, edges: DataFrame) -> None:
    """Puts a task graph into a store."""

    def change(tx):
        tx.create(TASKS, rows, ["id"])
        tx.create(EDGES, edges)

    store.update(change)


def claim_next(store: Store, n: int = 1, v: Vocabulary = V, within: DataFrame | None = None) -> DataFrame:
    """The first n executable tasks, by priority, in their next state, taken for this caller alone.

    Choice and state change are one commit on one version. If another driver commits first, the choice is made again on its
    state, so no task is given out twice; only the claimed rows are written. ``within(id)`` limits the choice, as to a goal.
    """
    names = store.read(TASKS).columns

    def change(tx):
        rows = tx.read(TASKS)
        choice = tasks.executable(rows, tx.read(EDGES), v)  # blockers count wherever they are; only the choice is limited
        choice = choice if within is None else choice.join(within.select("id").distinct(), "id", "left_semi")
        wanted = tasks.ordered(choice).limit(n).withColumn("status", F.lit(v.states[1] if len(v.states) > 1 else v.states[0]))
        new = rows.join(F.broadcast(wanted.select("id", F.col("status").alias("_status"))), "id").withColumn("status", F.col("_status"))  # n rows
        return tx.upsert(TASKS, new.select(*names))

    return store.update(change)


def set_status(store: Store, ids: DataFrame, status: str, v: Vocabulary = V) -> None:
    """A new status for ``ids(id)``, a step along the declared order at most; an undeclared one, or a leap, is an error."""
    if status not in v.states:
        raise ValueError(f"unknown status {status}")

    def change(tx):
        rows = tx.read(TASKS).join(ids.select("id").distinct(), "id", "left_semi")
        leap = rows.where(~(F.col("status").eqNullSafe(F.lit(status)) | tasks.transition_allowed(F.col("status"), F.lit(status), v.states))).first()
        if leap:
            raise ValueError(f"task {leap['id']} cannot go from {leap['status']} to {status}")
        tx.upsert(TASKS, rows.withColumn("status", F.lit(status)))

    store.update(change)


def run_agent(store: Store, execute: Callable[[int, str], str], n: int = 8, rounds: int = 1000, v: Vocabulary = V) -> int:
    """Claims n tasks a round, runs each and writes their states back in one commit, until none is executable; their number.

    Any number of agents may run on one store. A task whose ``execute`` fails goes back to its first state and its error is
    raised after the round's other results are written.
    """
    done = 0
    for _ in range(rounds):
        rows = claim_next(store, n, v).select("id", "content").collect()  # n rows at most
        if not rows:
            return done
        new, errors = [], []
        for r in rows:
            try:
                new.append((r["id"], execute(r["id"], r["content"])))
            except Exception as e:  # noqa: BLE001 - any failure of the callback gives the task back
                errors.append(e)
                new.append((r["id"], v.states[0]))
        if bad := [s for _, s in new if s not in v.states]:
            raise ValueError(f"unknown status {bad[0]}")
        states = store.spark.createDataFrame(new, "id bigint, _status string")
        store.update(lambda tx, s=states: tx.upsert(TASKS, tx.read(TASKS).join(F.broadcast(s), "id").withColumn("status", F.col("_status"))))
        done += len(rows) - len(errors)
        if errors:
            raise errors[0]
    return done


def insert_episodes(store: Store, sessions: DataFrame, episodes: DataFrame, events: DataFrame, types: tuple[str, ...]) -> int:
    """Sessions, episodes and events of one batch, all or none: the new version.

    Known ids stay as they are. An event of an undeclared type or of an unknown episode, or an episode of an unknown session,
    fails the whole batch before anything is published.
    """

    def change(tx):
        for name, rows, key in (("sessions", sessions, "session_id"), ("episodes", episodes, "episode_id"), ("events", events, "id")):
            if tx.has(name):
                tx.upsert(name, rows.join(tx.read(name).select(key), key, "left_anti"))
            else:
                tx.create(name, rows.dropDuplicates([key]), [key])
        odd = events.where(~F.coalesce(F.col("type").isin(*types), F.lit(False))).first()
        lost = tx.read("events").join(tx.read("episodes").select("episode_id"), "episode_id", "left_anti").first()
        orphan = tx.read("episodes").join(tx.read("sessions").select("session_id"), "session_id", "left_anti").first()
        for row, what in ((odd, "undeclared type"), (lost, "unknown episode"), (orphan, "unknown session")):
            if row:
                raise ValueError(f"{what}: {row.asDict()}")

    store.update(change)
    return store.version()
