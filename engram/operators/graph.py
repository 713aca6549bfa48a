"""Graph operators: degrees, bounded walks, closures, components, communities, integrity and edge sinks.

Edges are made symmetric first, so every step is an equi-join. Loops advance level by level and drop what was seen by an
anti-join; each level is written to scratch where a loop may be long, so lineage stays short.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.components import connected_components
from engram.operators.cycles import KEY, accepted, closing
from engram.schema import DEPTH_CEILING, MAX_NODES
from engram.sources.scratch import Scratch


def symmetrize(edges: DataFrame) -> DataFrame:
    """``(id, neighbor, relation_type, weight)`` in both directions; a self-loop appears twice."""
    return edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor"), "relation_type", "weight").union(edges.select("target_id", "source_id", "relation_type", "weight"))


def degree(edges: DataFrame) -> DataFrame:
    """Edges in plus edges out; a self-loop counts twice."""
    return symmetrize(edges).groupBy("id").agg(F.count("*").alias("degree"))


def average_neighbor_degree(edges: DataFrame) -> DataFrame:
    """Mean degree over the neighbours of each entity, parallel edges counted."""
    d = degree(edges).withColumnRenamed("id", "neighbor")
    return symmetrize(edges).select("id", "neighbor").join(d, "neighbor").groupBy("id").agg(F.avg("degree").alias("avg_degree"))


def walk(entities: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 2, ceiling: int = DEPTH_CEILING, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """Bounded undirected walk over active entities, first hit kept: ``(id, depth, path_weight, parent_id, relation_type)``.

    A first hit has the least depth, then the least path weight, then parent and relation. A shortest path has only
    nodes at their own least depth before its end, so going level by level with the least (weight, parent, relation) per
    node equals enumerating all simple paths. ``max_nodes`` keeps the first in (depth, category, id) order. Symmetric edges,
    live entities and each level but the last are written once, so no level computes them, or the levels before, anew.
    """
    scratch = Scratch(entities.sparkSession)
    live = scratch.save(entities.where("not coalesce(archived, false)").select("id", "category"), "live")
    none = {"parent_id": "bigint", "relation_type": "string"}
    level = live.join(seeds.select("id").distinct(), "id").select("id", F.lit(0).alias("depth"), F.lit(0.0).alias("path_weight"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    seen, links, last = level, scratch.save(symmetrize(edges), "links"), min(max_depth or 2, ceiling)
    for depth in range(1, last + 1):
        step = level.select(F.col("id").alias("parent_id"), F.col("path_weight").alias("so_far")).join(links.withColumnRenamed("id", "parent_id"), "parent_id")
        hits = step.groupBy(F.col("neighbor").alias("id")).agg(F.min(F.struct((F.col("so_far") + F.coalesce("weight", F.lit(1.0))).alias("path_weight"), "parent_id", "relation_type")).alias("h"))
        level = hits.join(live.select("id"), "id", "left_semi").join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "h.path_weight", "h.parent_id", "h.relation_type")
        level = level if depth == last else scratch.save(level, f"level{depth}")
        seen = seen.union(level)
    if max_nodes is None:
        return seen
    return seen.join(live, "id").orderBy("depth", "category", "id").limit(max_nodes).drop("category")


def closure(edges: DataFrame, seeds: DataFrame, scratch: Scratch, forward: bool = True, relation: str | None = None, max_rounds: int = 4096) -> DataFrame:
    """Everything reachable from ``seeds(id)``, themselves at depth 0: ``(id, depth)``. Ends on cyclic data too."""
    links = edges if relation is None else edges.where(F.col("relation_type") == relation)
    links = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")) if forward else links.select(F.col("target_id").alias("id"), F.col("source_id").alias("to"))
    links = scratch.save(links.distinct(), "links")
    level = scratch.save(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "level0")
    seen = level
    for i in range(1, max_rounds + 1):
        level = scratch.save(level.select("id").join(links, "id").select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(i)), f"level{i}")
        if level.isEmpty():
            return seen
        seen = seen.union(level) if i % 16 else scratch.save(seen.union(level), f"seen{i}")
    raise RuntimeError("the closure exceeds its limit of rounds")


def reaches(edges: DataFrame, start: int, goal: int, relation: str, scratch: Scratch) -> bool:
    """Whether ``goal`` can be reached from ``start`` along one relation: an edge goal -> start would close a cycle."""
    seeds = edges.sparkSession.createDataFrame([(start,)], "id bigint")
    return not closure(edges, seeds, scratch, relation=relation).where(F.col("id") == goal).isEmpty()


def components(entities: DataFrame, edges: DataFrame, scratch: Scratch, min_size: int = 1) -> DataFrame:
    """``(component, size, avg_degree)``: active entities and what their edges reach, archived ids included."""
    pairs = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    cc = connected_components(pairs, scratch)
    live = entities.where("not coalesce(archived, false)").select(F.col("id").alias("node"))
    every = live.join(cc, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    reached = cc.join(every.select("component").distinct(), "component", "left_semi").select("node", "component")
    members = every.union(reached).distinct()
    per = members.join(degree(edges).withColumnRenamed("id", "node"), "node", "left").groupBy("component").agg(F.count("*").alias("size"), (F.sum(F.coalesce("degree", F.lit(0))) / F.count("*")).alias("avg_degree"))
    return per.where(F.col("size") >= min_size)


def community_graph(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected weights between active entities, parallel edges summed, self-loops left out: ``(a, b, w)``, a < b."""
    live = entities.where("not coalesce(archived, false)").select("id")
    e = edges.join(live.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(live.withColumnRenamed("id", "target_id"), "target_id", "left_semi").where("source_id <> target_id")
    return e.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("weight").alias("w"))


def modularity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Global modularity over adjacent pairs inside communities: one row ``(modularity)``.

    Sum over ordered adjacent pairs of one community of (w - k_i k_j / 2m) / 2m, with m the sum of weights.
    """
    both = graph.select("a", "b", "w").union(graph.select("b", "a", "w"))
    k = both.groupBy("a").agg(F.sum("w").alias("k"))
    total = graph.agg(F.sum("w").alias("m"))
    ends = lambda x: labels.select(F.col("id").alias(x), F.col("community").alias(f"c{x}"))
    inside = both.join(ends("a"), "a").join(ends("b"), "b").where("ca = cb")
    inside = inside.join(k.withColumnRenamed("k", "ka"), "a").join(k.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
    q = inside.crossJoin(F.broadcast(total)).agg(F.sum((F.col("w") - F.col("ka") * F.col("kb") / (2 * F.col("m"))) / (2 * F.col("m"))).alias("q"))
    return q.select(F.coalesce("q", F.lit(0.0)).alias("modularity"))


def community_modularity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """``(community, size, modularity)`` over all member pairs: inner / 2m - (sum of k / 2m) squared, per community."""
    both = graph.select("a", "b", "w").union(graph.select("b", "a", "w"))
    k = both.groupBy("a").agg(F.sum("w").alias("k")).withColumnRenamed("a", "id")
    total = graph.agg(F.sum("w").alias("m"))
    ends = lambda x: labels.select(F.col("id").alias(x), F.col("community").alias(f"c{x}"))
    inner = both.join(ends("a"), "a").join(ends("b"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inner"))
    per = labels.join(k, "id", "left").groupBy("community").agg(F.count("*").alias("size"), F.sum(F.coalesce("k", F.lit(0.0))).alias("kc"))
    out = per.join(inner, "community", "left").crossJoin(F.broadcast(total))
    return out.select("community", "size", (F.coalesce("inner", F.lit(0.0)) / (2 * F.col("m")) - F.pow(F.col("kc") / (2 * F.col("m")), 2)).alias("modularity"))


def louvain(graph: DataFrame, nodes: DataFrame, scratch: Scratch, max_iterations: int = 50) -> DataFrame:
    """Sequential local moving, one task per connected component: ``(id, community)``; a community is its least member.

    Nodes move in id order to the neighbouring community of greatest gain; ties go to the community seen first in
    order. A move depends on the moves before it, so a component is the unit of work: 12 bytes a link and end, and a
    handful of sweeps, as sweeps that would come round again are not run.
    """
    m = graph.agg(F.sum("w")).first()[0] or 1.0
    cc = connected_components(graph.select("a", "b"), scratch, "louvain")
    both = graph.select("a", "b", "w").union(graph.select("b", "a", "w"))
    rows = both.join(cc.select(F.col("node").alias("a"), "component"), "a")

    def move(df: pd.DataFrame) -> pd.DataFrame:
        order, a = np.unique(df.a.to_numpy(), return_inverse=True)
        b = np.searchsorted(order, df.b.to_numpy())
        by = np.lexsort((b, a))
        starts = np.searchsorted(a[by], np.arange(len(order) + 1)).tolist()
        own = _moves(starts, array("i", b[by].astype("i4").tobytes()), array("d", df.w.to_numpy("f8")[by].tobytes()), m, max_iterations)
        _, first, community = np.unique(own, return_index=True, return_inverse=True)
        return pd.DataFrame({"id": order, "community": order[first[community]]})

    found = rows.groupBy("component").applyInPandas(lambda df: move(df), "id bigint, community bigint")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _moves(starts: list[int], to: array, w: array, m: float, sweeps: int) -> list[int]:
    """The community of each node after ``sweeps``; node ``v`` has the links ``starts[v]`` to ``starts[v + 1]``, by node.

    A sweep depends on communities and their totals only. Where both are as after an earlier sweep (Brent's way: one is
    kept, that of the last power of two), whole turns from there on change nothing and are left out.
    """
    n = len(starts) - 1
    k = [sum(w[starts[v] : starts[v + 1]]) for v in range(n)]
    own, total, kept, left, i = list(range(n)), list(k), None, sweeps, 0
    while left:
        moved = False
        for v in range(n):
            p, q, old, kv = starts[v], starts[v + 1], own[v], k[v]
            weight: dict[int, float] = {}
            for u, x in zip(to[p:q], w[p:q], strict=True):
                c = own[u]
                weight[c] = weight.get(c, 0.0) + x
            total[old] -= kv
            gain, best = 0.0, old
            for c, x in weight.items():
                if c != old:
                    dq = x / m - kv * total[c] / (2 * m * m)
                    if dq > gain or (dq == gain and dq > 0 and c < best):
                        gain, best = dq, c
            own[v], moved = best, moved or best != old
            total[best] += kv
        i, left = i + 1, left - 1
        if not moved:
            break
        if kept and kept[1] == own and kept[2] == total:
            left %= i - kept[0]
        if i & (i - 1) == 0:
            kept = (i, list(own), list(total))
    return own


def local_moves(graph: DataFrame, nodes: DataFrame, scratch: Scratch, rounds: int = 20) -> DataFrame:
    """Distributed local moving for graphs with a component too large for one task: ``(id, community)``.

    In each round the nodes of one half, chosen by hash, move to the neighbouring community of greatest gain over
    staying. Rounds are equi-joins and partially aggregated sums. The partition is near that of ``louvain``, not equal:
    moves of a round do not see each other.
    """
    both = scratch.save(graph.select("a", "b", "w").union(graph.select("b", "a", "w")), "moves_edges")
    m = both.agg(F.sum("w") / 2).first()[0]
    labels = scratch.save(nodes.select("id", F.col("id").alias("community")).distinct(), "moves0")
    if not m:
        return labels
    k = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "moves_k")
    still = 0
    for i in range(1, rounds + 1):
        total = labels.join(k, "id").groupBy("community").agg(F.sum("k").alias("total"))
        own = labels.join(k, "id").select("id", "k", F.col("community").alias("own"))
        near = both.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
        near = near.unionByName(own.select("id", F.col("own").alias("community"), F.lit(0.0).alias("w"))).groupBy("id", "community").agg(F.sum("w").alias("w"))
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") / m - F.col("k") * rest / (2 * m * m), 12)
        best = near.join(own, "id").join(total, "community").withColumn("gain", gain).groupBy("id").agg(F.max(F.struct("gain", (F.col("community") == F.col("own")).alias("stay"), (-F.col("community")).alias("low"))).alias("x"))
        turn = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0
        moved = labels.join(best.where(turn).select("id", (-F.col("x.low")).alias("to")), "id", "left").select("id", F.coalesce("to", "community").alias("community"), (F.coalesce("to", "community") != F.col("community")).alias("moved"))
        moved = scratch.save(moved, f"moves{i}")
        still = 0 if not moved.where("moved").isEmpty() else still + 1
        labels = moved.drop("moved")
        if still == 3:
            break
    least = labels.groupBy("community").agg(F.min("id").alias("least"))
    return labels.join(least, "community").select("id", F.col("least").alias("community"))


def contradictions(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of active entities joined by a contradicts edge."""
    live = entities.where("not coalesce(archived, false)")
    side = lambda x: live.select(F.col("id").alias(f"{x}_id"), F.col("content").alias(f"{x}_content"))
    return edges.where("relation_type = 'contradicts'").select("source_id", "target_id").join(side("source"), "source_id").join(side("target"), "target_id")


def orphan_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is missing, with flags."""
    ids = entities.select("id").distinct()
    s, t = ids.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source")), ids.select(F.col("id").alias("target_id"), F.lit(True).alias("has_target"))
    flagged = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    return flagged.where("has_source is null or has_target is null").select(*KEY, F.col("has_source").isNull().alias("missing_source"), F.col("has_target").isNull().alias("missing_target"))


def dimension_mismatch(entities: DataFrame, dim: int) -> DataFrame:
    """Entities whose embedding has another length."""
    return entities.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).select("id", F.size("embedding").alias("dim"))


def verify(entities: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """Issues as text: orphan edges and wrong dimensions."""
    o = orphan_edges(entities, edges).select(F.lit("orphan_edge").alias("kind"), F.format_string("%s -> %s (%s)", "source_id", "target_id", "relation_type").alias("subject"))
    return o.union(dimension_mismatch(entities, dim).select(F.lit("dim_mismatch"), F.format_string("%s: %s", "id", "dim")))


def add_edges(entities: DataFrame, edges: DataFrame, new: DataFrame, relations: list[str], create_missing: bool = False, scratch: Scratch | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, entities, rejected): new edges of a declared relation whose ends exist; a weight of 0 counts 1.

    ``create_missing`` adds placeholder entities instead of rejecting. With ``scratch`` edges that close a cycle along
    their relation are rejected too: with ``order`` (a column) as if inserted one by one in that order, else all that lie on
    a cycle together. The bulk form leaves that check out.
    """
    new = new.withColumn("weight", F.when(F.coalesce("weight", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("weight")))
    known = F.col("relation_type").isin(relations)
    rejected = new.where(~known)
    good = new.where(known)
    if create_missing:
        ends = good.select(F.col("source_id").alias("id")).union(good.select("target_id")).distinct()
        fresh = ends.join(entities.select("id"), "id", "left_anti").select("id", F.lit("world").alias("category"), F.col("id").cast("string").alias("content"))
        entities = entities.unionByName(fresh, allowMissingColumns=True)
    else:
        bad = orphan_edges(entities, good).select(*KEY)
        rejected = rejected.unionByName(good.join(bad, KEY, "left_semi"))
        good = good.join(bad, KEY, "left_anti")
    if scratch is not None:
        bad = closing(edges, good, scratch) if order is None else good.select(*KEY).join(accepted(edges, good, order, scratch), KEY, "left_anti").distinct()
        rejected = rejected.unionByName(good.join(bad, KEY, "left_semi"))
        good = good.join(bad, KEY, "left_anti")
    kept = edges.select(*KEY, "weight").join(good.select(*KEY), KEY, "left_anti")
    return kept.unionByName(good.select(*KEY, "weight").dropDuplicates(KEY)), entities, rejected


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*KEY), KEY, "left_anti")


def purge(entities: DataFrame, edges: DataFrame, ids: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities without ``ids(id)`` and edges that touch none of them; with ``strict`` an absent id is an error."""
    gone = ids.select("id").distinct()
    if strict and (absent := gone.join(entities.select("id"), "id", "left_anti").first()):
        raise KeyError(f"no entity {absent['id']}")
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return entities.join(gone, "id", "left_anti"), left.select(*edges.columns)


def upsert(entities: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Full-row replacement by key; edges are kept by the caller."""
    return entities.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def lineage_labels(entities: DataFrame) -> DataFrame:
    """Source label and creation time for display: an empty source is unknown, a missing creation time is the update time."""
    return entities.select("id", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown_or_deleted_source")).alias("source"), F.coalesce("created_at", "updated_at").alias("created_at"))
