"""Levels and critical tasks of a task graph: longest weighted paths over ``blocked_by`` edges.

1. Chains first: an edge that is the only one out of its source and the only one into its target is a step of a chain.
   Pointers double until every task knows the head of its chain and what the way from there does to a weight that arrives,
   in as many rounds as the logarithm of the longest chain. All other edges lead from a chain's end to a chain's head.
2. Whole chains are then taken as soon as all edges into them are: a round reads the links of the chains that came last and
   writes these and the ones that wait for more, so each link is followed once.

What is never taken, or turns in a ring, waits for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from engram.operators.cycles import strongly_connected
from engram.operators.tasks import V
from engram.schema import Vocabulary
from engram.sources.scratch import Scratch


class _Cycle(Exception):
    pass


def _chained(rows: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(id, weight, head, steps, best, sum)``: the chain of each node by its head, and the steps from there.

    A way that reaches the head with total ``x`` reaches the node with ``greatest(best, sum + x)``; ``best`` begins on the
    chain itself. They differ where weights are negative. ``links(a, b, weight)``, the weight that of ``b``.
    """
    kind = rows.schema["weight"].dataType
    only = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    single = links.groupBy("b", "weight").agg(F.count("*").alias("n")).where("n = 1").select("b", "weight")
    one = scratch.save(only.join(single, "b").select(F.col("b").alias("v"), F.col("a").alias("to"), F.col("weight").alias("best")), f"{name}_one")
    known = one.select(F.col("v").alias("to"), F.lit(True).alias("open"))
    moved = one.join(known, "to", "left").select("v", "to", F.coalesce("open", F.lit(False)).alias("open"), F.lit(1).alias("steps"), "best", F.col("best").alias("sum"))
    i, before, done = 0, None, []
    while True:  # only open pointers are written anew; the closed ones stay where they are
        moved = scratch.save(moved, f"{name}_hop{i}")
        done.append(moved.where("not open"))
        left = moved.where("open").count()
        if not left:
            break
        if left == before:  # on a path some pointer closes in every round
            raise _Cycle
        i, before, hop = i + 1, left, moved.where("open")
        for x in done:
            hop = hop.unionByName(x)
        ahead = hop.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("open").alias("open2"), F.col("steps").alias("steps2"), F.col("best").alias("best2"), F.col("sum").alias("sum2"))
        best = F.greatest("best", (F.col("sum") + F.col("best2")).cast(kind))
        moved = moved.where("open").drop("open").join(ahead, "to").select("v", F.col("to2").alias("to"), F.col("open2").alias("open"), (F.col("steps") + F.col("steps2")).alias("steps"), best.alias("best"), (F.col("sum") + F.col("sum2")).cast(kind).alias("sum"))
    hop = done[0]
    for x in done[1:]:
        hop = hop.unionByName(x)
    heads = rows.select(F.col("id").alias("to"), F.col("weight").alias("first"))
    inner = hop.join(heads, "to").select(F.col("v").alias("id"), F.col("to").alias("head"), "steps", F.greatest("best", (F.col("sum") + F.col("first")).cast(kind)).alias("best"), (F.col("sum") + F.col("first")).cast(kind).alias("sum"))
    every = rows.join(inner, "id", "left").select("id", "weight", F.coalesce("head", "id").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("best", "weight").alias("best"), F.coalesce("sum", "weight").alias("sum"))
    return scratch.save(every, f"{name}_placed")


def _taken(chains: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(id, level, above)``: the most nodes and the heaviest way before each chain that has a link in ``links(a, b)``.

    ``chains(id, size, best, sum)``. ``above`` is null where nothing leads to the chain.
    """
    kind = chains.schema["sum"].dataType
    need = links.groupBy("b").agg(F.count("*").alias("need"))
    to = chains.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("best").alias("best_b"), F.col("sum").alias("sum_b"))
    follow = scratch.save(links.join(need.join(to, "b"), "b"), f"{name}_follow")
    first = chains.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_semi").join(links.select(F.col("b").alias("id")), "id", "left_anti")
    ready = scratch.save(first.select("id", F.lit(0).alias("level"), F.lit(None).cast(kind).alias("above"), "size", "best", "sum"), f"{name}_met0")
    out, part, waiting, i = [], [ready.select("id", "level", "above")], None, 0
    own = ["id", "size", "best", "sum", "need"]
    while not ready.isEmpty():
        i += 1
        through = F.greatest("best", (F.col("sum") + F.col("above")).cast(kind))
        sent = ready.select(F.col("id").alias("a"), (F.col("level") + F.col("size")).alias("level"), through.alias("above")).join(follow, "a")
        met = sent.select(F.col("b").alias("id"), F.col("size_b").alias("size"), F.col("best_b").alias("best"), F.col("sum_b").alias("sum"), "need", "level", "above", F.lit(1).cast("bigint").alias("n"))
        met = met if waiting is None else met.unionByName(waiting)
        met = scratch.save(met.groupBy(*own).agg(F.max("level").alias("level"), F.max("above").alias("above"), F.sum("n").alias("n")), f"{name}_met{i}")
        ready, waiting = met.where("n = need"), met.where("n < need")
        part.append(ready.select("id", "level", "above"))
        if len(part) == 16:
            out, part = [*out, scratch.save(_union(part), f"{name}_taken{i}")], []
            for j in range(i - 15, i):
                scratch.drop(f"{name}_met{j}")
    if waiting is not None and not waiting.isEmpty():
        raise _Cycle
    found = scratch.save(_union([*out, *part]), f"{name}_taken")
    if found.count() < links.select("a").union(links.select("b")).distinct().count():
        raise _Cycle
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _ways(rows: DataFrame, links: DataFrame, scratch: Scratch, name: str, back: bool) -> DataFrame:
    """``(id, weight, level, finish)``: the most links on a way to a node, and the heaviest way to it, its own weight
    included; with ``back`` also ``tail``, the heaviest way from it, which holds for exact weights from 0 on."""
    placed = _chained(rows, links, scratch, name)
    at = lambda c: F.max_by(c, "steps").alias(c)
    chains = scratch.save(placed.groupBy("head").agg(F.max_by("id", "steps").alias("last"), (F.max("steps") + 1).alias("size"), at("best"), at("sum")), f"{name}_chains")
    nodes = chains.select(F.col("head").alias("id"), "size", "best", "sum")
    between = scratch.save(links.join(chains.select(F.col("last").alias("a"), F.col("head").alias("from")), "a").join(chains.select(F.col("head").alias("b")), "b", "left_semi").select(F.col("from").alias("a"), "b"), f"{name}_between")
    level, above, after = F.lit(0), F.lit(None).cast(rows.schema["weight"].dataType), F.lit(0)
    if not between.isEmpty():
        chains = chains.join(_taken(nodes, between, scratch, f"{name}_on").withColumnRenamed("id", "head"), "head", "left")
        level, above = F.coalesce("level", F.lit(0)), F.col("above")
        if back:
            behind = _taken(nodes, between.select(F.col("b").alias("a"), F.col("a").alias("b")), scratch, f"{name}_back")
            chains = chains.join(behind.select(F.col("id").alias("head"), F.col("above").alias("after")), "head", "left")
            after = F.coalesce("after", F.lit(0))
    whole = chains.select("head", level.alias("level"), above.alias("above"), (F.col("sum") + after).alias("whole"))
    kind = rows.schema["weight"].dataType
    finish = F.greatest("best", (F.col("sum") + F.col("above")).cast(kind))
    tail = [(F.col("whole") - F.col("sum") + F.col("weight")).cast(kind).alias("tail")] if back else []
    return placed.join(whole, "head").select("id", "weight", (F.col("level") + F.col("steps")).alias("level"), finish.alias("finish"), *tail)


def schedule(tasks: DataFrame, edges: DataFrame, scratch: Scratch, weight: str = "weight", v: Vocabulary = V) -> DataFrame:
    """``(id, level, finish, tail, slack, critical)`` for every task.

    ``level`` orders the tasks topologically; ``finish`` is the heaviest chain that ends with the task, ``tail`` the heaviest
    that begins with it, both with its own weight; ``slack`` is what is missing to the heaviest chain of all, and a task is
    critical without slack. A null weight counts 0; edges to unknown tasks are left out; a cycle is an error.
    """
    rows = tasks.select("id", F.coalesce(F.col(weight), F.lit(0)).alias("weight")).dropDuplicates(["id"])
    kind = rows.schema["weight"].dataType
    if isinstance(kind, DecimalType):
        rows = rows.withColumn("weight", F.col("weight").cast(DecimalType(38, kind.scale)))
    rows = scratch.save(rows, "schedule_tasks")
    links = edges.where(F.col("relation_type") == v.blocking).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    links = links.join(rows.select(F.col("id").alias("a")), "a", "left_semi").join(rows.withColumnRenamed("id", "b"), "b").select("a", "b", "weight")
    links = scratch.save(links.distinct(), "schedule_links")
    exact = isinstance(kind, DecimalType | IntegralType) and not (rows.agg(F.min("weight")).first()[0] or 0) < 0
    try:
        both = _ways(rows, links, scratch, "schedule", exact)
        if not exact:
            against = links.select(F.col("b").alias("a"), F.col("a").alias("b")).join(rows.withColumnRenamed("id", "b"), "b")
            both = both.join(_ways(rows, scratch.save(against, "schedule_against"), scratch, "schedule_tail", False).select("id", F.col("finish").alias("tail")), "id")
    except _Cycle:
        held = strongly_connected(links.select("a", "b"), scratch, "schedule_cycles").first()
        raise ValueError(f"task {held['node']} waits for itself") from None
    both = scratch.save(both, "schedule_both")
    whole = both.agg(F.max("finish").alias("whole"))  # one row
    slack = F.col("whole") - (F.col("finish") + F.col("tail") - F.col("weight"))
    return both.crossJoin(F.broadcast(whole)).select("id", "level", "finish", "tail", slack.alias("slack"), (slack == 0).alias("critical"))
