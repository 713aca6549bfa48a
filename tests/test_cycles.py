"""Strongly connected components and ordered edges against brute force."""

import random
import time

import pytest

from engram.operators import cycles, graph
from engram.sources.scratch import Scratch

EDGE = "source_id bigint, target_id bigint, relation_type string, weight double"


def reach(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = {}
    for v in {x for e in edges for x in e}:
        seen, todo = set(), list(near.get(v, ()))
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += near.get(u, ())
        out[v] = seen
    return out


def components(edges):
    r = reach(edges)
    return {v: min(u for u in r[v] if v in r[u]) for v in r if v in r[v]}


def random_graph(rng):
    """Chains, rings, trees into rings, forks and self-loops in one graph."""
    n, out = rng.randint(4, 40), []
    for _ in range(rng.randint(1, 6)):
        path = rng.sample(range(n), rng.randint(2, min(n, 12)))
        out += list(zip(path, path[1:], strict=False))
        if rng.random() < 0.4:
            out.append((path[-1], path[0]))
    out += [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, n // 2))]
    return out


def test_components_equal_brute_force(spark):
    """Forty graphs side by side, each with its own ids."""
    edges = [(1000 * i + a, 1000 * i + b) for i in range(40) for a, b in random_graph(random.Random(i))]
    got = cycles.strongly_connected(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark))
    assert {r["node"]: r["component"] for r in got.collect()} == components(edges)


def test_shapes(spark):
    ring = [(i, (i + 1) % 9) for i in range(9)]
    lead = [(100 + i, 99 + i) for i in range(2, 30)] + [(101, 3)]
    cases = [[], [(1, 2), (2, 3)], ring + lead, ring + [(4, 50), (50, 51), (51, 8)], [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (None, 1), (1, None), (1, 2), (7, 7)]]
    for edges in cases:
        got = cycles.strongly_connected(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark))
        assert {r["node"]: r["component"] for r in got.collect()} == components([e for e in edges if None not in e])


def test_a_long_chain_takes_few_rounds_and_rows(spark):
    """10,000 new edges in a row, and the one that closes them: pointers double, so rows are n log n at most."""
    saved = []

    class Counting(Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            saved.append(name)
            return out

    n = 10_000
    chain = spark.range(n).selectExpr("id as source_id", "id + 1 as target_id", "'next' as relation_type", "1.0D as weight")
    none = spark.createDataFrame([], EDGE)
    t = time.time()
    assert cycles.closing(none, chain, Counting(spark)).count() == 0
    open_chain = len(saved)
    back = spark.createDataFrame([(n, 0, "next", 1.0)], EDGE)
    assert cycles.closing(chain, back, Counting(spark)).count() == 1
    assert open_chain < 40 and len(saved) - open_chain < 60
    assert time.time() - t < 120


def one_by_one(old, new):
    have, taken = list(old), []
    for e in new:
        if e[0] == e[1] or e[0] in reach(have).get(e[1], ()):
            continue
        have.append(e)
        taken.append(e)
    return set(taken)


def test_ordered_edges_equal_insertion_one_by_one(spark):
    """Four graphs side by side, their new edges dealt in turn."""
    rng, old, new = random.Random(7), [], []
    for i in range(4):
        n = rng.randint(3, 5)
        pick = lambda k, i=i, n=n: [(100 * i + rng.randrange(n), 100 * i + rng.randrange(n)) for _ in range(k)]
        old += pick(rng.randint(0, 5))
        new += pick(rng.randint(2, 5))
    rng.shuffle(new)
    new = list(dict.fromkeys(new))
    rows = spark.createDataFrame([(a, b, "next", 1.0) for a, b in old], EDGE)
    placed = spark.createDataFrame([(a, b, "next", i) for i, (a, b) in enumerate(new)], "source_id bigint, target_id bigint, relation_type string, at int")
    got = {(r["source_id"], r["target_id"]) for r in cycles.accepted(rows, placed, "at", Scratch(spark)).collect()}
    assert got == one_by_one(old, new)


def test_relations_do_not_mix_and_the_sink_keeps_order(spark):
    other = cycles.closing(spark.createDataFrame([(1, 2, "x", 1.0)], EDGE), spark.createDataFrame([(2, 1, "y", 1.0)], EDGE), Scratch(spark))
    assert other.count() == 0
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    new = spark.createDataFrame([(0, 1, "next", 1.0, 3), (1, 0, "next", 1.0, 2), (2, 2, "next", 1.0, 1), (2, 3, "next", 1.0, 9)], EDGE + ", at int")
    kept, _, bad = graph.add_edges(nodes, spark.createDataFrame([], EDGE), new, ["next"], scratch=Scratch(spark), order="at")
    assert {(r["source_id"], r["target_id"]) for r in kept.collect()} == {(1, 0), (2, 3)}
    assert {(r["source_id"], r["target_id"]) for r in bad.collect()} == {(0, 1), (2, 2)}
    with pytest.raises(ValueError):
        cycles.accepted(kept, kept, "nowhere", Scratch(spark))
