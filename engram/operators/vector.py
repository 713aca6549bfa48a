"""Exact vector search and similarity joins.

The kernel is a matrix product over slices of bounded size. Queries go to the workers in blocks of bounded size; every task
keeps only its best k per query, so what is shuffled for the final ranking is small. Joins of all rows against all rows
deal both sides into blocks and compare block pairs, so no task ever holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.vectors import cosine
from engram.operators.ranks import global_rank
from engram.schema import MAX_K
from engram.sources.scratch import Scratch


def check_k(k: int) -> int:
    if not 0 <= k <= MAX_K:
        raise ValueError(f"k must lie between 0 and {MAX_K}")
    return k


def active(entities: DataFrame) -> DataFrame:
    """Entities that are not archived and have an embedding."""
    return entities.where("not coalesce(archived, false) and embedding is not null")


def _nearest(entities: DataFrame, query: list[float], k: int, id_col: str) -> DataFrame:
    """The k best active entities by ``similarity``, those of the query's dimension only.

    Entities of another dimension are left out, and an error of the job if there are no others. That is decided on the k
    rows that are left, where those that fit come first, so the scan neither fails on a bad row nor runs twice.
    """
    if not query:
        raise ValueError("the query vector is empty")
    q = F.array(*[F.lit(float(x)) for x in query])
    fits = F.size("embedding") == len(query)
    scored = active(entities).withColumn("similarity", F.when(fits, F.round(cosine(F.col("embedding"), q), 6)))
    best = scored.orderBy(F.desc_nulls_last("similarity"), id_col).limit(k)
    some = F.max(F.col("similarity").isNotNull()).over(Window.partitionBy())  # k rows at most
    wrong = F.raise_error(F.concat(F.lit(f"dimension mismatch: the query has {len(query)}, the entities "), F.size("embedding").cast("string")))
    return best.withColumn("similarity", F.when(some, F.col("similarity")).otherwise(wrong.cast("double"))).where("similarity is not null")


def search_by_vector(entities: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k nearest active entities with all their columns and ``similarity``; k beyond ``MAX_K`` counts ``MAX_K``."""
    return _nearest(entities, query, check_k(min(k, MAX_K)), "id")


def store(entities: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """Entities with ``rows(id, embedding)`` as new vectors; a vector of another dimension is an error of the job."""
    new = rows.select("id", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit("dimension mismatch")).cast(rows.schema["embedding"].dataType)).alias("_new"))
    return entities.join(new, "id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).select(*entities.columns)


def remove(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities without the vectors of ``ids(id)``; the rows stay."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    return entities.join(gone, "id", "left").withColumn("embedding", F.when(F.col("_gone").isNull(), F.col("embedding"))).select(*entities.columns)


def index_stats(entities: DataFrame) -> DataFrame:
    """One row: active vectors, their dimensions and the archived share."""
    live = ~F.coalesce("archived", F.lit(False)) & F.col("embedding").isNotNull()
    return entities.agg(F.count(F.when(live, 1)).alias("n_vectors"), F.min(F.when(live, F.size("embedding"))).alias("min_dim"), F.max(F.when(live, F.size("embedding"))).alias("max_dim"), F.round(F.avg(F.coalesce("archived", F.lit(False)).cast("double")), 6).alias("archived_ratio"))


def search(entities: DataFrame, query: list[float], k: int = 5, id_col: str = "id") -> DataFrame:
    """The k active entities nearest to one vector: ``(id, similarity)``. The scan ends in TakeOrderedAndProject."""
    return _nearest(entities.select(id_col, "embedding", "archived"), query, check_k(k), id_col).select(id_col, "similarity")


def unit(v: list | np.ndarray) -> np.ndarray:
    m = np.array(v, np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def search_batch(entities: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 4096, id_col: str = "id") -> DataFrame:
    """The k nearest entities of every query: ``(query_id, id, similarity, rank)``.

    ``queries(query_id, embedding)`` are read in blocks of about ``query_block`` rows; one block is at the driver and in a
    plan at a time, as each block's pass over the entities is written before the next begins.
    """
    check_k(k)
    blocks = max(1, -(-queries.count() // query_block))
    parts, scratch = [], Scratch(entities.sparkSession) if blocks > 1 else None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = part.select("query_id", "embedding").orderBy("query_id").collect()
        if rows:
            best = _best(entities, [r["query_id"] for r in rows], unit([r["embedding"] for r in rows]), k, id_col)
            parts.append(scratch.save(best, f"batch{i}") if scratch else best)
    if not parts:
        return entities.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Similarities computed at once: four bytes each.
CELLS = 1 << 21


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as one matrix of doubles; all rows must have one length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def candidates(x: np.ndarray, y: np.ndarray, floor: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, similarity)`` of unit rows: all that reach ``floor[i]``, or with ``k`` all that reach the k best of a row and it.

    Products are formed in single precision, with a margin above its largest error, and again in double precision for what
    is left; similarities are rounded to six digits. Not-a-number counts as the greatest, as in SQL.
    """
    near = x.astype(np.float32) @ y.astype(np.float32).T
    margin = 2e-6 + 1.2e-7 * x.shape[1]
    if k is not None and 0 < k < len(y):
        low = floor == -np.inf
        floor = floor.copy()
        floor[low] = np.partition(near[low], len(y) - k, axis=1)[:, len(y) - k]
    i, j = np.nonzero(~(near < (floor - margin).astype(np.float32)[:, None]))
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], y[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
    return i, j, np.round(exact, 6) + 0.0


def best_of(group: np.ndarray, ids: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group, groups ascending; ties go to the lesser id."""
    order = np.lexsort((ids, np.where(np.isnan(similarity), -np.inf, -similarity), group))
    ranked = group[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]


def _best(entities: DataFrame, ids: list, q: np.ndarray, k: int, id_col: str) -> DataFrame:
    """Each task's k best for every query; slices of its rows meet all queries, and only those that beat the kth so far stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(ids, np.int64)
        query, found, similarity = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor, rows = np.full(len(names), -np.inf), max(1, CELLS // len(names))
        for batch in batches:
            own, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for at in range(0, batch.num_rows, rows):
                i, j, sim = candidates(q, unit(matrix(vectors.slice(at, rows))), floor, k)
                query, found, similarity = np.concatenate([query, i]), np.concatenate([found, own[at + j]]), np.concatenate([similarity, sim])
                kept = best_of(query, found, similarity, k)
                query, found, similarity = query[kept], found[kept], similarity[kept]
                last = np.arange(len(query)) - np.searchsorted(query, query) == k - 1
                floor[query[last]] = similarity[last]
        for at in range(0, len(query), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[query[part]]), pa.array(found[part]), pa.array(similarity[part])], ["query_id", "id", "similarity"])

    return active(entities).select(F.col(id_col).cast("bigint"), "embedding").mapInArrow(run, "query_id bigint, id bigint, similarity double")


def compare_blocks(threshold: float | None = None, k: int | None = None):
    """For ``applyInPandas`` over block pairs ``(x, y)`` of rows ``(own, id, embedding)``: similar pairs, or each row's best k."""

    def compare(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x, y = key
        left, right = df[df.own == x], df[df.own == y]
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        u, v = unit(list(left.embedding)), unit(list(right.embedding))
        sides = (left.id.to_numpy(), u), (right.id.to_numpy(), v)
        out = []
        for (pi, p), (qi, q) in (sides,) if x == y or k is None else (sides, sides[::-1]):
            rows = max(1, CELLS // len(q))
            for at in range(0, len(p), rows):
                part = p[at : at + rows]
                i, j, sim = candidates(part, q, np.full(len(part), -np.inf if k is not None else threshold), k)
                a, b = pi[at + i], qi[j]
                if k is None:
                    kept = (sim >= threshold) & ((x != y) | (a < b))
                    out.append(pd.DataFrame({"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept], "similarity": sim[kept]}))
                else:
                    kept = best_of(i, b, sim, k)
                    out.append(pd.DataFrame({"a": a[kept], "b": b[kept], "similarity": sim[kept]}))
        return pd.concat(out)

    return compare


def block_pairs(entities: DataFrame, threshold: float | None = None, k: int | None = None, block: int = 4096, id_col: str = "id") -> DataFrame:
    """All-pairs similarity ``(a, b, similarity)`` by block pairs.

    With ``threshold``: pairs a < b at or above it. With ``k``: the best k partners of every a inside each block, for a
    later ranking. Rows are dealt into n / block blocks; each pair of blocks is one group of at most two blocks.
    """
    rows = active(entities).select(F.col(id_col).cast("bigint").alias("id"), "embedding")
    n = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "embedding")
    return pairs.groupBy("x", "y").applyInPandas(compare_blocks(threshold, k), "a bigint, b bigint, similarity double")


def nearest(entities: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k nearest entities of every entity, itself included: ``(a, b, similarity, rank)``."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return block_pairs(entities, k=k, block=block).withColumn("rank", rank).where(F.col("rank") <= k)


def autolink(entities: DataFrame, threshold: float = 0.85, k: int = 3) -> DataFrame:
    """Links to those of the k nearest, self counted, that are another entity and above the threshold."""
    return nearest(entities, k).where((F.col("a") != F.col("b")) & (F.col("similarity") > threshold)).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "similarity")


def dedup_match(entities: DataFrame, incoming: DataFrame, threshold: float = 0.88) -> DataFrame:
    """The nearest entity of each incoming row if it reaches the threshold, else null: ``(query_id, match_id, similarity)``."""
    best = search_batch(entities, incoming, 1).where(F.col("similarity") >= threshold).select("query_id", F.col("id").alias("match_id"), "similarity")
    return incoming.select("query_id").join(best, "query_id", "left")


def named_match(entities: DataFrame, incoming: DataFrame, threshold: float = 0.88) -> DataFrame:
    """``dedup_match`` where each row of ``incoming(query_id, embedding, about)`` may only match the active entity ``about``."""
    known = active(entities).select(F.col("id").alias("match_id"), F.col("embedding").alias("_known"))
    similarity = F.round(cosine(F.col("_known"), F.col("embedding")), 6) + 0.0
    best = incoming.join(known, F.col("about") == F.col("match_id")).withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("query_id", "match_id", "similarity")
    return incoming.select("query_id").join(best, "query_id", "left")


def evict(entities: DataFrame, stored_at: str, limit: int = 500_000, id_col: str = "id") -> DataFrame:
    """The ``limit`` most recently stored entities. Only ids and times are ordered, by range partitions."""
    scratch = Scratch(entities.sparkSession)
    kept = global_rank(entities.select(id_col, stored_at), [F.col(stored_at).desc_nulls_last(), F.col(id_col)], scratch, "stored").where(F.col("rank") < limit).select(id_col)
    return entities.join(kept, id_col, "left_semi")
