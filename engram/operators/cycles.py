"""Strongly connected components, and edges taken in order as long as they close no cycle.

An edge lies on a cycle if and only if its ends share a component, so one decomposition answers for all edges at once.

1. Chains first: a node with one edge out is on a cycle only through its successor. Pointers double until each such node
   knows the end of its chain, in as many rounds as the logarithm of the longest chain; the graph between chain ends is
   solved, edges reversed, in the same way; what lies on a chain between two nodes of one component belongs to it, which the
   same pointers spread back. Rings without a way out are found by their pointers alone.
2. The rest is trimmed of nodes without edges in or out, then coloured: the greatest node that reaches a node is its colour,
   and what reaches the greatest within its colour is its component.

Every step is an equi-join over tables in scratch. Chains cost a row a node and doubling, trimming and colouring at most the
edges left a round; their rounds grow with the depth of what is left once chains are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.sources.scratch import Scratch

KEY = ["source_id", "target_id", "relation_type"]


def strongly_connected(edges: DataFrame, scratch: Scratch, name: str = "scc") -> DataFrame:
    """``(node, component)`` for all nodes of ``edges(a, b)`` on a cycle, self-loops included; component = least node.

    Edges with a null end are left out; repeated edges count once. Nodes may be of any type that can be ordered.
    """
    graph = scratch.save(edges.where("a is not null and b is not null").select("a", "b").distinct(), f"{name}_0")
    found = _solve(graph, scratch, name, 0)
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return scratch.save(found.join(least, "component").select("node", F.col("least").alias("component")), f"{name}_found")


def _solve(graph: DataFrame, scratch: Scratch, name: str, turn: int) -> DataFrame:
    """Contracts chains while they are a quarter of the edges, then peels and colours."""
    n = graph.count()
    one = scratch.save(graph.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to")).where("n = 1 and a <> to").select(F.col("a").alias("v"), "to"), f"{name}_{turn}_one")
    if 4 * one.count() < max(n, 1):
        return _peel(graph, scratch, f"{name}_{turn}")
    hops, tops, rings = _chains(one, scratch, f"{name}_{turn}")
    ends = tops.select("v", F.col("to").alias("top"), "open")
    forks = graph.join(one.select(F.col("v").alias("a")), "a", "left_anti").join(ends, F.col("b") == F.col("v"), "left")
    forks = scratch.save(forks.where("not coalesce(open, false)").select("a", "b", F.coalesce("top", "b").alias("top")), f"{name}_{turn}_forks")
    core = scratch.save(forks.select(F.col("top").alias("a"), F.col("a").alias("b")).distinct(), f"{name}_{turn}_core")
    inner = scratch.save(_solve(core, scratch, name, turn + 1), f"{name}_{turn}_inner")
    side = lambda x: inner.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    live = forks.where("b <> top").join(side("a"), "a").join(side("top"), "top").where("c_a = c_top").select(F.col("b").alias("node"), F.col("c_a").alias("component")).distinct()
    live = scratch.save(live, f"{name}_{turn}_live")
    for k, hop in enumerate([] if live.isEmpty() else hops):  # steps of 1, 2, 4, ... reach every node further down the chain
        live = scratch.save(live.union(live.join(hop.where("open").select(F.col("v").alias("node"), "to"), "node").select("to", "component")).distinct(), f"{name}_{turn}_live{k}")
    return inner.union(live).union(rings)


def _chains(one: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Pointer tables of 1, 2, 4, ... steps, the last of them, and the nodes of rings with their least node.

    ``open``: the pointer has not left the chains. Rounds end when no pointer is open or when nothing changes any more: the
    open ones then go round in rings, and their targets are the nodes of the rings.
    """
    known = one.select(F.col("v").alias("to"), F.lit(True).alias("open"))
    hop = scratch.save(one.join(known, "to", "left").select("v", "to", F.coalesce("open", F.lit(False)).alias("open"), F.col("v").alias("least")), f"{name}_hop0")
    hops, before = [], None
    while True:
        n = hop.where("open").count()
        now = (n, *_turning(hop)) if before and n == before[0] else (n,)  # while pointers close, the rest need not be looked at
        if not n or now == before:
            break
        hops, before = [*hops, hop], now
        ahead = hop.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("open").alias("open2"), F.col("least").alias("least2"))
        moved = hop.where("open").join(ahead, "to").select("v", F.col("to2").alias("to"), F.col("open2").alias("open"), F.least("least", "least2").alias("least"))
        hop = scratch.save(hop.where("not open").unionByName(moved), f"{name}_hop{len(hops)}")
    on = hop.where("open").select(F.col("to").alias("v")).distinct()
    return hops, hop, hop.join(on, "v", "left_semi").select(F.col("v").alias("node"), F.col("least").alias("component"))


def _turning(hop: DataFrame) -> tuple:
    """How many targets the open pointers have, and a digest of the least nodes."""
    return tuple(hop.where("open").agg(F.count_distinct("to"), F.sum(F.xxhash64("least").cast("decimal(38,0)"))).first())


def _peel(graph: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    out, n, i = [], graph.count(), 0
    while n:
        while True:  # edges whose ends have edges in and out
            i += 1
            graph = scratch.save(graph.join(graph.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(graph.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), f"{name}_trim{i}")
            before, n = n, graph.count()
            if n == before:
                break
        if not n:
            break
        colour = _colours(graph, scratch, f"{name}_colour{i}")
        tinted = lambda x, c=colour: c.select(F.col("node").alias(x), F.col("colour").alias(f"c_{x}"))
        within = scratch.save(graph.join(tinted("a"), "a").join(tinted("b"), "b").where("c_a = c_b").select("a", "b", F.col("c_a").alias("colour")), f"{name}_within{i}")
        found = level = scratch.save(colour.where("node = colour").select("node"), f"{name}_root{i}")
        j = 0
        while not level.isEmpty():
            j += 1
            level = scratch.save(within.join(level.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti"), f"{name}_back{i}_{j}")
            found = found.union(level) if j % 16 else scratch.save(found.union(level), f"{name}_reached{i}_{j}")
        found = scratch.save(found.join(colour, "node"), f"{name}_part{i}")
        loops = within.where("a = b").select(F.col("a").alias("node"))
        size = found.groupBy("colour").agg(F.count("*").alias("n"))
        out.append(found.join(size, "colour").join(loops.withColumn("loop", F.lit(True)), "node", "left").where("n > 1 or loop").select("node", F.col("colour").alias("component")))
        done = found.select("node")
        graph = scratch.save(within.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), f"{name}_rest{i}")
        n = graph.count()
    empty = graph.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    for x in out:
        empty = empty.union(x)
    return empty


def _colours(graph: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, colour)``: the greatest node that reaches each, itself counted. Only changed nodes push on."""
    colour = front = scratch.save(graph.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")), f"{name}_0")
    i = 0
    while not front.isEmpty():
        i += 1
        push = graph.join(front.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("pushed"))
        both = colour.join(push, "node", "left").select("node", F.greatest("colour", F.coalesce("pushed", "colour")).alias("colour"), F.coalesce(F.col("pushed") > F.col("colour"), F.lit(False)).alias("changed"))
        both = scratch.save(both, f"{name}_{i}")
        colour, front = both.select("node", "colour"), both.where("changed").select("node", "colour")
    return colour


def links(edges: DataFrame, *more: str, kinds: DataFrame | None = None) -> DataFrame:
    """Edges between (relation, id) pairs, with the columns ``more``: relations do not mix.

    With ``kinds(kind)`` only edges of these relations; where it is one, the id alone stands for the pair.
    """
    if kinds is not None:
        edges = edges.join(kinds, F.col("relation_type").eqNullSafe(F.col("kind")), "left_semi")
    if kinds is not None and kinds.count() == 1:
        return edges.select(*KEY, F.col("source_id").alias("a"), F.col("target_id").alias("b"), *more)
    end = lambda c, name: F.when(F.col(c).isNotNull(), F.struct(F.col("relation_type").alias("relation"), F.col(c).alias("id"))).alias(name)
    return edges.select(*KEY, end("source_id", "a"), end("target_id", "b"), *more)


def _inside(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``rows(a, b, ...)`` with ``component``: that of both ends, null where they share none."""
    side = lambda x: components.select(F.col("node").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"))
    both = rows.join(side("a"), F.col("a") == F.col("n_a"), "left").join(side("b"), F.col("b") == F.col("n_b"), "left")
    return both.select(*rows.columns, F.when(F.col("c_a") == F.col("c_b"), F.col("c_a")).alias("component"))


def closing(edges: DataFrame, new: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``new`` that lie on a cycle along their relation, in ``edges`` and ``new`` together.

    Of several new edges that close one cycle only together, all are returned; ``accepted`` takes them in order.
    """
    kinds = scratch.save(new.select(F.col("relation_type").alias("kind")).distinct(), "cycle_kinds")
    want = scratch.save(links(new, kinds=kinds).distinct(), "cycle_new")
    components = strongly_connected(links(edges, kinds=kinds).union(want), scratch, "cycle")
    return _inside(want, components).where("component is not null").select(*KEY)


def accepted(edges: DataFrame, new: DataFrame, order: str, scratch: Scratch) -> DataFrame:
    """The edges of ``new`` that insertion one by one by ``order`` takes: none that closes a cycle along its relation with
    ``edges`` and the ones taken before it.

    What lies on no cycle of all edges together is taken at once. In each component the others are tried in order: the
    longest prefix without a cycle is found by halving, all components side by side; it is taken, the edge after it is
    not, and the rest goes on. So decompositions are as many as the rejected edges of the worst component, times the
    logarithm of its new edges. Repeated edges count once, at their first place; an edge in ``edges`` already is a repeat.
    """
    if order not in new.columns:
        raise ValueError(f"no column {order}")
    kinds = scratch.save(new.select(F.col("relation_type").alias("kind")).distinct(), "order_kinds")
    have = scratch.save(links(edges, kinds=kinds).select("a", "b").distinct(), "order_have0")
    todo = links(new, order, kinds=kinds).groupBy(*KEY, "a", "b").agg(F.min(order).alias("at"))
    old = strongly_connected(have, scratch, "order_old")
    todo = scratch.save(_inside(todo, old).where("component is null").drop("component"), "order_todo0")
    taken, i = [], 0
    while True:
        i += 1
        marked = scratch.save(_inside(todo, strongly_connected(have.union(todo.select("a", "b")), scratch, f"order{i}")), f"order_marked{i}")
        free = marked.where("component is null")
        taken.append(free.select(*KEY))
        place = F.row_number().over(Window.partitionBy("component").orderBy("at", *KEY))
        ranked = scratch.save(marked.where("component is not null").withColumn("place", place), f"order_ranked{i}")
        if ranked.isEmpty():
            break
        have = scratch.save(have.union(free.select("a", "b")), f"order_have{i}")
        bounds = scratch.save(ranked.groupBy("component").agg(F.lit(0).alias("low"), F.max("place").alias("high")), f"order_bounds{i}_0")
        j = 0
        while not bounds.where("high - low > 1").isEmpty():
            j += 1
            middle = bounds.withColumn("middle", F.floor((F.col("low") + F.col("high")) / 2).cast("int"))
            tried = scratch.save(ranked.join(middle.where("high - low > 1"), "component").where("place <= middle").select("a", "b", F.col("component").alias("of")), f"order_tried{i}_{j}")
            held = _inside(tried, strongly_connected(have.union(tried.select("a", "b")), scratch, f"order{i}_{j}")).where("component is not null").select(F.col("of").alias("component")).distinct().withColumn("cyclic", F.lit(True))
            both = middle.join(held, "component", "left")
            half = F.col("high") - F.col("low") > 1
            bounds = scratch.save(both.select("component", F.when(half & F.col("cyclic").isNull(), F.col("middle")).otherwise(F.col("low")).alias("low"), F.when(half & F.col("cyclic"), F.col("middle")).otherwise(F.col("high")).alias("high")), f"order_bounds{i}_{j}")
        decided = ranked.join(bounds, "component")
        good = decided.where("place <= low")
        taken.append(good.select(*KEY))
        have = scratch.save(have.union(good.select("a", "b")), f"order_more{i}")
        todo = scratch.save(decided.where("place > high").select(*KEY, "a", "b", "at"), f"order_todo{i}")
    out = taken[0]
    for x in taken[1:]:
        out = out.union(x)
    return out
