"""An inverted-list index over the active vectors: approximate nearest neighbours and exact similarity joins.

Directions found by spherical k-means on a bounded sample split the unit sphere; every vector lies in the list of its
nearest direction, and a list of any size is dealt into blocks of bounded size, so equal vectors in great number are no hot
group. The directions, at most ``max_lists``, are what the workers are sent.

* ``search``: a query reads the lists of its ``probes`` nearest directions. ``fit`` sets ``probes`` as the least number that
  meets ``recall`` on queries of the sample against the sample. ``vector.search_batch`` is the exact way.
* ``similar``: exact. By the triangle inequality for angles, a vector at an angle of at most t to one in a list lies at most
  t + r from the list's direction, with r the list's largest angle. Each vector goes only to the pairs of blocks it may meet
  in, so block pairs without a candidate are never formed; both vectors of a pair meet in exactly one. With a low threshold
  or unclustered data every list is in reach and the work is that of ``vector.block_pairs``.

Rows without embedding, archived ones and those of another dimension than ``dim`` are left out; a zero vector has similarity
0 to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.operators.vector import active, check_k, compare_blocks, unit
from engram.sources.scratch import Scratch

#: Similarities are rounded to six digits before they are compared.
ROUNDED = 1e-6
ROWS = "id bigint, embedding array<double>, list int, angle double"


@dataclass(frozen=True)
class Index:
    """``rows(id, embedding, list, angle)`` with unit vectors; per list its direction, size and largest angle."""

    rows: DataFrame
    directions: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    probes: int
    block: int

    @property
    def pieces(self) -> np.ndarray:
        """Blocks per list."""
        return -(-self.sizes // self.block)

    @property
    def first(self) -> np.ndarray:
        """The number of each list's first block."""
        return np.cumsum(self.pieces) - self.pieces


def k_means(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit directions by spherical k-means; empty ones are dropped."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        own = nearest_direction(sample, at)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        at = sums[norms > 0] / norms[norms > 0, None]
    return at


def nearest_direction(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(vectors[i : i + 4096] @ directions.T, axis=1) for i in range(0, len(vectors), 4096)]) if len(vectors) else np.zeros(0, np.int64)


def least_probes(sample: np.ndarray, directions: np.ndarray, recall: float, k: int, queries: int = 256) -> int:
    """The least number of lists whose vectors hold the share ``recall`` of the k nearest of sample queries."""
    if not len(sample):
        return 1
    own, asked = nearest_direction(sample, directions), sample[:queries]
    best = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ directions.T), axis=1, kind="stable"), axis=1)  # of each list in a query's order
    needed = np.sort(place[np.arange(len(asked))[:, None], own[best]].ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column as one matrix; all rows have one length."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _lists(vectors: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))


def assign(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """``(id, embedding)`` as ``ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit(_vectors(batch.column(1)))
                near = v @ directions.T
                own = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(v), pa.array(own.astype(np.int32)), pa.array(angle)], ["id", "embedding", "list", "angle"])

    return rows.mapInArrow(run, ROWS)


def _measured(rows: DataFrame, directions: np.ndarray, probes: int, block: int) -> Index:
    sizes, radii = np.zeros(len(directions), np.int64), np.zeros(len(directions))
    for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():  # one row a list
        sizes[r["list"]], radii[r["list"]] = r["n"], r["r"]
    return Index(rows, directions, sizes, radii, min(probes, len(directions)), block)


def usable(entities: DataFrame, dim: int, id_col: str = "id") -> DataFrame:
    return active(entities).where(F.size("embedding") == dim).select(F.col(id_col).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def fit(entities: DataFrame, dim: int, scratch: Scratch, lists: int | None = None, sample: int = 20_000, max_lists: int = 1024, recall: float = 0.95, k: int = 10, block: int = 4096, id_col: str = "id") -> Index:
    """The index of all usable entities. At most ``sample`` vectors, drawn by a hash of their id, reach the driver to fit
    ``lists`` directions (by default the root of the number of vectors, ``max_lists`` at most)."""
    rows = usable(entities, dim, id_col)
    n = rows.count()
    if not n:
        return Index(scratch.save(assign(rows, np.zeros((1, dim))), "index"), np.zeros((1, dim)), np.zeros(1, np.int64), np.zeros(1), 1, block)
    share = min(1.0, 1.2 * sample / n)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding").limit(sample)
    found = unit(np.array([r[0] for r in drawn.collect()], np.float64).reshape(-1, dim))
    found = found[np.linalg.norm(found, axis=1) > 0]
    if not len(found):
        found = np.eye(1, dim)
    directions = k_means(found, lists or max(1, min(max_lists, int(np.sqrt(n)))))
    return _measured(scratch.save(assign(rows, directions), "index"), directions, least_probes(found, directions, recall, k), block)


def add(index: Index, entities: DataFrame, scratch: Scratch, name: str, id_col: str = "id") -> Index:
    """The index with more entities in its lists, or new vectors for known ids; directions stay."""
    new = scratch.save(assign(usable(entities, index.directions.shape[1], id_col), index.directions), f"{name}_new")
    old = index.rows.join(new.select("id"), "id", "left_anti").select(*new.columns)
    return _measured(scratch.save(old.unionByName(new), name), index.directions, index.probes, index.block)


def probes_for(index: Index, share: float) -> Index:
    """The index with so many probes as a share of its lists."""
    return replace(index, probes=max(1, int(np.ceil(share * len(index.directions)))))


def _own_block(first: np.ndarray, pieces: np.ndarray) -> F.Column:
    """The block of a row of the index: its list's first block plus a hash of its id."""
    start, count = (F.array(*[F.lit(int(x)) for x in a]) for a in (first, np.maximum(pieces, 1)))
    return (F.get(start, F.col("list")) + F.pmod(F.xxhash64("id"), F.get(count, F.col("list")))).cast("int")


def _blocks_of(first: np.ndarray, pieces: np.ndarray, reached: np.ndarray) -> pa.Array:
    """Per row of a boolean matrix over lists, the numbers of all blocks of the lists in reach, each once."""
    lists = [np.unique(np.concatenate([np.arange(first[i], first[i] + pieces[i]) for i in np.flatnonzero(row)] or [np.zeros(0, np.int64)])) for row in reached]
    ends = np.cumsum([0, *(len(x) for x in lists)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)))


def packed(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """``(first, pieces)``: blocks of lists where small lists of near directions share one, so that blocks are as many as rows
    ask for and not as lists are. Each list is followed by the nearest one left."""
    first, pieces, left = np.zeros(len(index.sizes), np.int64), index.pieces, np.ones(len(index.sizes), bool)
    at, block, filled = 0, -1, index.block
    for _ in range(len(index.sizes)):
        left[at] = False
        size = index.sizes[at]
        if filled + size > index.block:
            block, filled = block + 1, 0
        first[at] = block
        if size > index.block:
            block, filled = block + pieces[at] - 1, index.block
        else:
            filled += size
        at = int(np.argmax(np.where(left, index.directions @ index.directions[at], -np.inf)))
    return first, pieces


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest rows of every query in the lists it reads: ``(query_id, id, similarity, rank)``.

    A block meets the queries that read its list, dealt into groups of about ``block``; of each meeting only k rows a query
    remain before the ranking.
    """
    check_k(k)
    bare = replace(index, rows=None)
    dim = index.directions.shape[1]

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit(_vectors(batch.column(1)))
                near = np.argsort(-(v @ bare.directions.T), axis=1, kind="stable")[:, : bare.probes]
                reached = np.zeros((len(v), len(bare.directions)), bool)
                np.put_along_axis(reached, near, True, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(v), _blocks_of(bare.first, bare.pieces, reached)], ["query_id", "embedding", "blocks"])

    asked = queries.where(F.size("embedding") == dim).select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding"))
    deals = max(1, -(-queries.count() * index.probes // max(1, len(index.directions) * index.block)))
    deal = F.pmod(F.xxhash64("query_id"), F.lit(int(deals))).cast("int").alias("deal")
    asked = asked.mapInArrow(reach, "query_id bigint, embedding array<double>, blocks array<int>").select("query_id", "embedding", F.explode("blocks").alias("block"), deal)
    met = asked.select(F.col("block").alias("b"), F.col("deal").alias("d")).distinct()
    rows = index.rows.select("id", "embedding", _own_block(index.first, index.pieces).alias("own")).join(met, F.col("own") == F.col("b")).select("id", "embedding", F.col("b").alias("block"), F.col("d").alias("deal"))

    def best(_: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        sim = np.round(np.stack(q.embedding.to_list()) @ np.stack(r.embedding.to_list()).T, 6) + 0.0
        ids = r.id.to_numpy()
        order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
        row = np.arange(len(q))[:, None].repeat(order.shape[1], axis=1)
        return pd.DataFrame({"query_id": q.query_id.to_numpy()[row.ravel()], "id": ids[order.ravel()], "similarity": sim[row.ravel(), order.ravel()]})

    found = asked.groupBy("block", "deal").cogroup(rows.groupBy("block", "deal")).applyInPandas(best, "query_id bigint, id bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def meetings(index: Index, threshold: float) -> DataFrame:
    """``(x, y, own, id, embedding)``: each row once for every pair of blocks in which it may find a partner."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    bare = replace(index, rows=None)
    first, pieces = packed(index)
    widest = np.arccos(max(-1.0, threshold - ROUNDED)) + bare.radii + 1e-6

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = np.arccos(np.clip(_vectors(batch.column(1)) @ bare.directions.T, -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, _blocks_of(first, pieces, angle <= widest)], ["id", "embedding", "own", "others"])

    rows = index.rows.select("id", "embedding", _own_block(first, pieces).alias("own")).mapInArrow(reach, "id bigint, embedding array<double>, own int, others array<int>")
    return rows.withColumn("other", F.explode("others")).select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "embedding")


def similar(index: Index, threshold: float) -> DataFrame:
    """All pairs ``(a, b, similarity)``, a < b, at or above ``threshold``; the same as ``vector.block_pairs``."""
    return meetings(index, threshold).groupBy("x", "y").applyInPandas(compare_blocks(threshold), "a bigint, b bigint, similarity double")


def links(index: Index, threshold: float, k: int = 3) -> DataFrame:
    """``vector.autolink`` on the index: of the k nearest of each entity, itself counted, those above ``threshold``.

    Whatever is nearer than a neighbour above the threshold is above it too, so the pairs of the join are enough.
    """
    pairs = similar(index, threshold)
    every = pairs.union(pairs.select("b", "a", "similarity")).union(index.rows.where(F.exists("embedding", lambda x: x != 0)).select("id", F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    near = every.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("a") != F.col("b")) & (F.col("similarity") > threshold))
    return near.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "similarity")
