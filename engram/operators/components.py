"""Connected components without collecting links: alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.sources.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` as ``(node, component)``, component = least node.

    Alternating large-star and small-star steps: every step is a partially aggregated minimum and an equi-join whose
    hot side adaptive execution can split, so a hub costs no more than its edges. Each round is written to scratch.
    No row for a node without an edge to another node.
    """
    cur = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    state, done = _digest(cur), cur.isEmpty()
    for i in range(1, max_rounds + 1):
        if done:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.save(large.distinct(), f"{name}{i}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        nxt = scratch.save(small.distinct(), f"{name}{i}")
        scratch.drop(f"{name}{i}l")
        after = _digest(nxt)
        scratch.drop(f"{name}{i - 1}")
        done, state, cur = after == state, after, nxt
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
