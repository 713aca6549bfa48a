"""Task graph: executability, claims, subtrees, aborts, rollbacks and recovery.

A ``blocked_by`` edge leads from the blocker (source) to the blocked task (target).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.graph import closure
from engram.schema import Vocabulary
from engram.sources.scratch import Scratch

V = Vocabulary()
COLUMNS = ["id", "status", "priority", "content"]


def open_tasks(tasks: DataFrame, v: Vocabulary = V) -> DataFrame:
    return tasks.where(F.col("category").isin(*v.task_categories) & (F.col("status") == v.states[0]) & ~F.coalesce("archived", F.lit(False)))


def blocked(tasks: DataFrame, edges: DataFrame, v: Vocabulary = V) -> DataFrame:
    """Ids with a blocker that is not done; a blocker without status does not block."""
    blockers = tasks.where(F.col("status") != v.done).select(F.col("id").alias("source_id"))
    return edges.where(F.col("relation_type") == v.blocking).join(blockers, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()


def executable(tasks: DataFrame, edges: DataFrame, v: Vocabulary = V) -> DataFrame:
    return open_tasks(tasks, v).join(blocked(tasks, edges, v), "id", "left_anti").select(*COLUMNS)


def ordered(tasks: DataFrame) -> DataFrame:
    """By priority, highest first, then id."""
    return tasks.orderBy(F.coalesce("priority", F.lit(0)).desc(), "id")


def claim(tasks: DataFrame, edges: DataFrame, n: int = 1, v: Vocabulary = V) -> DataFrame:
    """The first n executable tasks with their next state. The caller writes them back; there is one driver."""
    return ordered(executable(tasks, edges, v)).limit(n).withColumn("status", F.lit(v.states[1] if len(v.states) > 1 else v.states[0]))


def claim_and_write(tasks: DataFrame, edges: DataFrame, scratch: Scratch, n: int = 1, v: Vocabulary = V) -> tuple[DataFrame, DataFrame]:
    """(claimed, tasks): the first n executable tasks are taken once, and the table has their new state.

    The claim is written before it is applied, so both results show the same tasks. One driver claims at a time.
    """
    taken = scratch.save(claim(tasks, edges, n, v), "claimed")
    new = taken.select("id", F.col("status").alias("_status"))
    return taken, tasks.join(new, "id", "left").withColumn("status", F.coalesce("_status", "status")).select(*tasks.columns)


def listing(tasks: DataFrame, categories: list[str] | None = None, status: str | None = None, within: DataFrame | None = None, limit: int | None = None, v: Vocabulary = V) -> DataFrame:
    """Live tasks by category set, status and membership in ``within(id)``, by priority."""
    df = tasks.where(F.col("category").isin(*(categories or v.task_categories)) & ~F.coalesce("archived", F.lit(False)))
    df = df if status is None else df.where(F.col("status") == status)
    df = ordered(df if within is None else df.join(within.select("id").distinct(), "id", "left_semi"))
    return df if limit is None else df.limit(max(0, limit))


def create(tasks: DataFrame, rows: DataFrame, v: Vocabulary = V) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected): new tasks of a declared category and state; an empty status is the first state."""
    rows = rows.withColumn("status", initial_status(F.col("status"), v.states))
    ok = F.coalesce(F.col("category").isin(*v.task_categories) & F.col("status").isin(*v.states), F.lit(False))
    fresh = rows.where(ok).join(tasks.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return tasks.unionByName(fresh, allowMissingColumns=True), rows.where(~ok)


def goals(tasks: DataFrame, edges: DataFrame, v: Vocabulary = V) -> DataFrame:
    """Roots as goals with the number of tasks that wait for each directly and how many of those are done."""
    waits = edges.where(F.col("relation_type") == v.blocking).select(F.col("source_id").alias("id"), F.col("target_id").alias("t"))
    per = waits.join(tasks.select(F.col("id").alias("t"), (F.col("status") == v.done).cast("bigint").alias("done")), "t").groupBy("id").agg(F.count("*").alias("n_tasks"), F.sum("done").alias("n_done"))
    return roots(tasks, edges, v).join(per, "id", "left").select("id", "status", F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), F.coalesce("n_done", F.lit(0)).alias("n_done"))


def claim_candidates(tasks: DataFrame, edges: DataFrame, goal: int, v: Vocabulary = V) -> DataFrame:
    """Executable tasks within a goal: the goal itself, or any task that blocks a live task."""
    live = tasks.where(F.col("category").isin(*v.task_categories) & ~F.coalesce("archived", F.lit(False)))
    pool = edges.where(F.col("relation_type") == v.blocking).join(live.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return executable(tasks, edges, v).join(pool.union(live.where(F.col("id") == goal).select("id")).distinct(), "id", "left_semi")


def roots(tasks: DataFrame, edges: DataFrame, v: Vocabulary = V) -> DataFrame:
    """Live tasks that nothing blocks, whatever the blocker's state."""
    live = tasks.where(F.col("category").isin(*v.task_categories) & ~F.coalesce("archived", F.lit(False)))
    targets = edges.where(F.col("relation_type") == v.blocking).select(F.col("target_id").alias("id")).distinct()
    return live.join(targets, "id", "left_anti").select(*COLUMNS)


def subtree(tasks: DataFrame, edges: DataFrame, goals: DataFrame, scratch: Scratch, forward: bool = False, v: Vocabulary = V) -> DataFrame:
    """Tasks reached from goals over blocking edges; ``forward`` follows source to target."""
    return closure(edges, goals, scratch, forward, v.blocking).join(tasks.where(~F.coalesce("archived", F.lit(False))), "id").select("depth", *COLUMNS)


def executable_for_goal(tasks: DataFrame, edges: DataFrame, goals: DataFrame, scratch: Scratch, v: Vocabulary = V) -> DataFrame:
    within = closure(edges, goals, scratch, True, v.blocking).select("id")
    return executable(tasks, edges, v).join(within, "id", "left_semi")


def cascade_abort(tasks: DataFrame, edges: DataFrame, failed: DataFrame, scratch: Scratch, terminal: str = "aborted", v: Vocabulary = V) -> DataFrame:
    """Live pending tasks downstream of failed ones, with the terminal state."""
    down = closure(edges, failed, scratch, True, v.blocking).where("depth > 0").select("id")
    return open_tasks(tasks, v).join(down, "id", "left_semi").select(*COLUMNS).withColumn("status", F.lit(terminal))


def cascade_rollback(tasks: DataFrame, edges: DataFrame, start: DataFrame, scratch: Scratch, context: str = "", limit: int = 4096, v: Vocabulary = V) -> DataFrame:
    """Dependents level by level, not through tasks already done: ``(id, depth, status, content)``; too many is an error."""
    links = scratch.save(edges.where(F.col("relation_type") == v.blocking).select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).distinct(), "rollback_links")
    todo = tasks.where(F.coalesce(F.col("status") != v.done, F.lit(True))).select("id")
    level = scratch.save(start.select("id").distinct().join(todo, "id", "left_semi").withColumn("depth", F.lit(0)), "rollback0")
    seen, i, total, new = level, 0, 0, level.count()
    while new:
        total += new
        if total > limit:
            raise RuntimeError(f"the rollback exceeds {limit} tasks")
        i += 1
        nxt = level.select("id").join(links, "id").select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").join(todo, "id", "left_semi")
        level = scratch.save(nxt.withColumn("depth", F.lit(i)), f"rollback{i}")
        seen, new = seen.union(level), level.count()
    note = F.concat(F.col("content"), F.lit(f"\n[ROLLBACK: {context}]")) if context else F.col("content")
    return seen.join(tasks, "id").select("id", "depth", F.lit(v.done or "rolled_back").alias("status"), note.alias("content"))


def recovery_plan(edges: DataFrame, start: int, scratch: Scratch, v: Vocabulary = V) -> DataFrame:
    """The chain over the least ``recovers_via`` target until it ends or meets itself: ``(step, id)``.

    Pointer doubling: each round doubles both the known part of the chain and the length of the jumps, so a chain of n
    steps takes log2(n) rounds of equi-joins, whatever its length.
    """
    jump = scratch.save(edges.where(F.col("relation_type") == v.recovery).groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("to")), "jump0")
    chain, known, i = scratch.save(edges.sparkSession.createDataFrame([(0, start)], "step bigint, id bigint"), "plan0"), 1, 0
    while True:
        i += 1
        further = chain.join(jump, "id").select((F.col("step") + F.lit(1 << (i - 1))).alias("step"), F.col("to").alias("id"))
        chain = scratch.save(chain.union(further).groupBy("id").agg(F.min("step").alias("step")).select("step", "id"), f"plan{i}")
        n = chain.count()
        if n == known:
            break
        known = n
        jump = scratch.save(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), f"jump{i}")
    return chain.where("step > 0").select(F.col("step").cast("int").alias("step"), "id")


def relations(edges: DataFrame, task: int, v: Vocabulary = V) -> DataFrame:
    """Edges of a task by role: what blocks it, what depends on it, what recovers it."""
    role = F.when((F.col("target_id") == task) & (F.col("relation_type") == v.blocking), "blocked_by").when((F.col("source_id") == task) & (F.col("relation_type") == v.blocking), "dependent").when((F.col("source_id") == task) & (F.col("relation_type") == v.recovery), "recovers_via")
    return edges.where((F.col("source_id") == task) | (F.col("target_id") == task)).withColumn("role", role).where("role is not null").select("role", "source_id", "target_id")


def tree(tasks: DataFrame, edges: DataFrame, root: int, scratch: Scratch, v: Vocabulary = V) -> list[tuple[int, int, str]]:
    """(depth, id, label) depth first over blockers as children; a repeated node is a leaf marked as a cycle.

    The closure runs on the cluster; only the tree of one root comes to the driver.
    """
    spark = edges.sparkSession
    within = closure(edges, spark.createDataFrame([(root,)], "id bigint"), scratch, False, v.blocking).select("id")
    links = edges.where(F.col("relation_type") == v.blocking).join(within.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("target_id", "source_id").distinct().collect()
    names = {r["id"]: r["content"] for r in tasks.join(within, "id", "left_semi").select("id", "content").collect()}
    children: dict[int, list[int]] = {}
    for t, s in links:
        children.setdefault(t, []).append(s)
    out, seen, stack = [], set(), [(0, root)]
    while stack:
        depth, node = stack.pop()
        cycle = node in seen
        out.append((depth, node, f"{names.get(node, node)}{' (cycle)' if cycle else ''}"))
        if not cycle:
            seen.add(node)
            stack += [(depth + 1, c) for c in sorted(children.get(node, []), reverse=True)]
    return out


def transition_allowed(old, new, states: tuple[str, ...] = V.states):
    """A valid state next to the old one in order; without an order every state is allowed."""
    if not states:
        return F.lit(True)
    order = F.array(*[F.lit(s) for s in states])
    a, b = F.array_position(order, old), F.array_position(order, new)
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) == 1), F.lit(False))


def initial_status(status, states: tuple[str, ...] = V.states):
    return F.coalesce(F.nullif(status, F.lit("")), F.lit(states[0]))


def set_status(tasks: DataFrame, ids: DataFrame, status: str, v: Vocabulary = V) -> DataFrame:
    """Tasks with a new status for ``ids``; an undeclared status is an error."""
    if status not in v.states:
        raise ValueError(f"unknown status {status}")
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return tasks.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit").select(*tasks.columns)


def agent_loop(tasks: DataFrame, edges: DataFrame, execute: Callable[[int, str], str], scratch: Scratch, rounds: int = 10, v: Vocabulary = V) -> DataFrame:
    """Claim one task per round, run it and write its state back; ends when nothing is executable."""
    for i in range(rounds):
        row = claim(tasks, edges, 1, v).first()
        if row is None:
            break
        one = tasks.sparkSession.createDataFrame([(row["id"],)], "id bigint")
        tasks = scratch.save(set_status(tasks, one, execute(row["id"], row["content"]), v), f"loop{i}")
    return tasks
