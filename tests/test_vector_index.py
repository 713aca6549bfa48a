"""The inverted-list index: recall against brute force, the exact join against all pairs, and hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import maintenance, vector, vector_index
from engram.sources import tables as T
from engram.sources.scratch import Scratch

SCHEMA = "id bigint, embedding array<double>, archived boolean"


def clustered(spark, n=1500, centres=25, dim=16, spread=0.12, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    v = at[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim)) * rng.random((n, 1))
    return spark.createDataFrame([(i, [float(x) for x in r], False) for i, r in enumerate(v)], SCHEMA), v


def pairs(df):
    return {(r["a"], r["b"], r["similarity"]) for r in df.collect()}


def test_recall_of_the_stated_queries_on_the_given_vectors(spark):
    """Ids divisible by 20 against all rows, the index at its own setting, at sf0.1."""
    e = T.entities(spark, "/root/testdata/sf0.1")
    queries = T.read(spark, "/root/testdata/sf0.1", "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.fit(e, 64, Scratch(spark))
    found = {(r["query_id"], r["id"]) for r in vector_index.search(index, queries, 10).collect()}
    exact = {(r["query_id"], r["id"]) for r in vector.search_batch(e, queries, 10).collect()}
    assert len(exact) == 1000 and len(found & exact) / len(exact) >= 0.9
    assert index.rows.count() == vector.active(e).count()  # every row is indexed


def test_recall_and_work_on_clustered_vectors(spark):
    e, v = clustered(spark)
    index = vector_index.fit(e, 16, Scratch(spark), recall=0.99)
    queries = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = {(r["query_id"], r["id"]) for r in vector_index.search(index, queries, 10).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = {(q, int(i)) for q in range(0, len(v), 20) for i in np.lexsort((np.arange(len(v)), -np.round(u @ u[q], 6)))[:10]}
    assert len(found & best) / len(best) >= 0.95
    assert index.probes < len(index.directions) / 2
    all_lists = vector_index.probes_for(index, 1.0)
    assert {(r["query_id"], r["id"]) for r in vector_index.search(all_lists, queries, 10).collect()} == best


@pytest.mark.parametrize("threshold", [0.2, 0.75, 0.85, 0.97])
def test_the_join_loses_no_pair(spark, threshold):
    e, _ = clustered(spark, 700)
    index = vector_index.fit(e, 16, Scratch(spark), block=50)
    assert pairs(vector_index.similar(index, threshold)) == pairs(vector.block_pairs(e, threshold=threshold))


def test_block_pairs_without_a_candidate_are_never_formed(spark):
    e, _ = clustered(spark, 1500, centres=25, spread=0.05)
    index = vector_index.fit(e, 16, Scratch(spark), lists=25, block=100)
    met = vector_index.meetings(index, 0.9)
    blocks = int(index.pieces.sum())
    assert met.select("x", "y").distinct().count() < blocks * (blocks + 1) / 2 / 3
    assert met.count() < 1500 * blocks / 3


def test_equal_vectors_in_great_number_are_dealt_into_blocks(spark):
    e, _ = clustered(spark, 300)
    hot = spark.range(10_000, 10_400).select("id", F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(16)]).alias("embedding"), F.lit(False).alias("archived"))
    index = vector_index.fit(e.union(hot), 16, Scratch(spark), block=64)
    assert index.sizes.max() >= 400 and index.pieces.max() >= 6
    assert vector_index.similar(index, 0.999).where("a >= 10000").count() == 400 * 399 // 2
    largest = vector_index.meetings(index, 0.999).groupBy("x", "y").count().agg(F.max("count")).first()[0]
    assert largest < 4 * 64


def test_links_matches_and_clusters_equal_the_exact_way(spark):
    e, _ = clustered(spark, 500)
    index = vector_index.fit(e, 16, Scratch(spark))
    key = lambda df: {tuple(r) for r in df.collect()}
    assert key(vector_index.links(index, 0.85)) == key(vector.autolink(e, 0.85)) != set()
    full = e.withColumn("category", F.lit("world"))
    assert key(maintenance.greedy_clusters(full, Scratch(spark), 0.8, index=index)) == key(maintenance.greedy_clusters(full, Scratch(spark), 0.8)) != set()


def test_more_rows_are_added_and_known_ones_replaced(spark):
    e, _ = clustered(spark, 400)
    scratch = Scratch(spark)
    index = vector_index.fit(e.where("id < 300"), 16, scratch)
    moved = spark.createDataFrame([(5, [1.0] * 16, False)], SCHEMA)
    more = vector_index.add(index, e.where("id >= 300").union(moved), scratch, "more")
    want = e.where("id <> 5").union(moved)
    assert more.sizes.sum() == 400
    assert pairs(vector_index.similar(more, 0.8)) == pairs(vector.block_pairs(want, threshold=0.8))


def test_index_on_hard_rows(spark):
    rows = [(1, [1.0, 0.0], False), (2, None, False), (3, [1.0, 0.0], True), (4, [0.0, 0.0], False), (5, [1.0, 0.0, 0.0], False), (6, [0.9, 0.1], None), (6, [0.9, 0.1], None)]
    e = spark.createDataFrame(rows, SCHEMA)
    index = vector_index.fit(e, 2, Scratch(spark))
    assert sorted(r["id"] for r in index.rows.collect()) == [1, 4, 6, 6]
    assert {(a, b) for a, b, _ in pairs(vector_index.similar(index, 0.9))} == {(1, 6)}
    empty = vector_index.fit(e.where("id > 100"), 2, Scratch(spark))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id bigint, embedding array<double>")
    assert vector_index.search(empty, q, 3).count() == 0 and vector_index.similar(empty, 0.5).count() == 0
    assert {r["query_id"] for r in vector_index.search(index, q, 3).collect()} == {1}
    with pytest.raises(ValueError):
        vector_index.similar(index, 0.0)


def test_batches_of_queries_are_read_one_after_another(spark):
    e, _ = clustered(spark, 200)
    q = e.select(F.col("id").alias("query_id"), "embedding")
    key = lambda n: {tuple(r) for r in vector.search_batch(e, q, 3, query_block=n).collect()}
    assert key(4096) == key(40)


def test_a_row_of_another_dimension_fails_no_search(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [1.0, 0.0, 0.0], False)], SCHEMA)
    assert [tuple(r) for r in vector.search(e, [1.0, 0.0], 5).collect()] == [(1, 1.0)]
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.search(e, [1.0], 5).collect()
