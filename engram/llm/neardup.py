"""MinHash near-dedup by min-max hashing.

Each permutation of the shingle hashes yields its minimum and its maximum, two nearly independent values for one
evaluation. ``2 * permutations`` values are cut into bands; documents that share a band meet in a bucket. With 80
permutations and bands of 5, a pair at similarity 0.8 misses all 32 bands with probability 3e-6.

Buckets never emit all their pairs:

1. Equal sets are one class, found by fingerprint; only the least document of a class goes on.
2. Every member of a bucket is confirmed on full sets against the bucket's most central document, the one whose
   buckets are largest. Confirmed links are joined to components, which settles groups of copies of any size with one
   pair per member and bucket.
3. Buckets that still hold several components: small ones (``small_bucket`` rows at most) compare the members of different components; the documents
   of larger ones go through an exact prefix and position filter (rarest shingles first), which needs no bound on
   group size. Both are exact; the limit only decides which is cheaper. Components over all links are the result.

Joins by bucket cut a bucket into parts by id (``spread``), so a bucket that holds a whole group of near copies is no
single task.

Edge cases: null, empty or blank text has an empty set, no links, and is its own component; a text of fewer words than
a shingle is one shingle; ties on the least id cannot occur between different ids; rows that repeat an id are one
document, linked by any of its texts, each with its own set size; rows with a null id are never linked; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.common import Scratch, connected_components, global_rank
from engram.llm.shingles import C1, Texts, finish, shingle_set

#: Parts of a bucket whose size is not known yet, and rows of a part where it is.
SALTS, PART = 8, 512
SIGNATURE = "id bigint, h bigint, n bigint, fp binary, keys array<bigint>"


def signatures(shingle: int, permutations: int, band_rows: int, seed: int):
    """The function for ``mapInArrow`` from (id, h, text) to (id, h, set size, set fingerprint, band keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 2**32, permutations, dtype=np.uint32)
        bands = 2 * permutations // band_rows
        salt = finish(np.arange(1, bands + 1, dtype=np.uint64) * C1)
        texts = Texts()
        for batch in batches:
            sizes, prints, keys = [], [], []
            for w in texts.rows(batch.column(2), lower=True):
                s = shingle_set(w, shingle)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if not len(s):
                    keys.append([])
                    continue
                x = (s >> np.uint64(32)).astype(np.uint32)
                low, high = np.full(permutations, 2**32 - 1, np.uint32), np.zeros(permutations, np.uint32)
                for at in range(0, len(x), 4096):
                    m = x[at : at + 4096, None] * a + b
                    low, high = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
                values = np.concatenate([low, high]).astype(np.uint64)[: bands * band_rows].reshape(bands, band_rows)
                h = salt.copy()
                for j in range(band_rows):
                    h = finish((h ^ values[:, j]) * C1)
                keys.append(h.view(np.int64))
            flat = pa.array(np.concatenate([np.asarray(k, np.int64) for k in keys]) if keys else np.empty(0, np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(ends, flat)], ["id", "h", "n", "fp", "keys"])

    return run


def confirm(shingle: int, percent: int):
    """The function for ``mapInArrow`` from (a, b, text of a, text of b) to the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = Texts(), Texts()
        for batch in batches:
            keep = []
            for i, (wa, wb) in enumerate(zip(left.rows(batch.column(2), lower=True), right.rows(batch.column(3), lower=True), strict=True)):
                sa, sb = shingle_set(wa, shingle), shingle_set(wb, shingle)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def explode_set(shingle: int):
    """The function for ``mapInArrow`` from (id, label, text) to (id, label, set size, array of shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts()
        for batch in batches:
            sets = [shingle_set(w, shingle).view(np.int64) for w in texts.rows(batch.column(2), lower=True)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["id", "label", "n", "s"])

    return run


def components(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, permutations: int = 80, band_rows: int = 5, small_bucket: int = 16, seed: int = 7) -> DataFrame:
    """One row per document: ``(key, n_shingles, component_id, kept)``; ids are integers."""
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    sig = scratch.save(source.mapInArrow(signatures(shingle, permutations, band_rows, seed), SIGNATURE), "signatures")
    # 1. equal sets
    sets = numbered(scratch.save(sig.where("n > 0 and id is not null").groupBy("fp", "n").agg(F.min("id").alias("id")), "sets"), scratch)
    rep_of = sig.select("id", "n", "fp").join(sets.select("fp", "n", "node"), ["fp", "n"], "left")
    nodes = sig.join(sets, ["id", "n", "fp"]).select(F.col("node").alias("id"), F.col("id").alias("doc"), "h", "n", "keys").dropDuplicates(["id"])
    reps = scratch.save(nodes, "nodes")
    # the texts of one id are one document
    own = rep_of.where("node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    own = scratch.save(rep_of.join(own, "id").where("node > a").select("a", F.col("node").alias("b")).distinct(), "own_links")
    # 2. buckets: one central document against each member
    rows = reps.select("id", "n", F.explode("keys").alias("k"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
    shared = scratch.save(spread(rows, sizes, F.lit(SALTS)).select("k", "id", "n", "m"), "shared")
    central = shared.groupBy("id").agg(F.sum("m").alias("c"))
    pivots = shared.join(central, "id").groupBy("k", "m").agg(F.max(F.struct("c", (-F.col("id")).alias("low"), "n")).alias("p"))
    members = scratch.save(spread(shared, pivots, salts(F.col("m")), "m").select("k", "id", "n", (-F.col("p.low")).alias("pivot"), F.col("p.n").alias("pivot_n"), "m"), "members")
    scratch.drop("shared")
    alike = lambda x, y: (100 * F.least(F.col(x), F.col(y)) >= percent * F.greatest(F.col(x), F.col(y)))
    first = scratch.save(members.where((F.col("id") != F.col("pivot")) & alike("n", "pivot_n")).select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct(), "first_pairs")
    wanted = members.select("id").distinct()
    wanted = reps.select("id", "doc", "h").join(wanted, "id").select(F.col("id").alias("node"), F.col("doc").alias("id"), "h")
    texts = scratch.save(source.join(wanted, ["id", "h"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "text"), "texts")
    links = scratch.save(verify(first, texts, shingle, percent), "first_links")
    labels = scratch.save(connected_components(links, scratch, "first").select(F.col("node").alias("id"), "component"), "first_labels")
    # 3. buckets that still hold several components
    named = members.where("m > 2").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id"))
    open_ = named.groupBy("k", "m").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("k", "m")
    rest = scratch.save(spread(named, open_, salts(F.col("m")), "m").select("k", "id", "n", "label", "m"), "rest")
    second = scratch.save(_small_pairs(rest.where(F.col("m") <= small_bucket), alike).union(_prefix_pairs(rest.where(F.col("m") > small_bucket), texts, shingle, percent, alike)).distinct().join(first, ["a", "b"], "left_anti"), "second_pairs")
    more = verify(second, texts, shingle, percent)
    links = scratch.save(links.union(more).union(own), "links")
    labels = scratch.save(connected_components(links, scratch, "all"), "labels")
    out = rep_of.join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def numbered(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``sets(fp, n, id)`` with a ``node``: the id, or a number beyond all ids for a further set of the same id."""
    first = sets.groupBy("id").agg(F.min("fp").alias("first"), F.count("*").alias("c")).where("c > 1").select("id", "first")
    more = scratch.save(sets.join(first, "id").where("fp <> first").select("fp", "n"), "more_sets")
    if more.isEmpty():
        return sets.withColumn("node", F.col("id"))
    top = sets.agg(F.max("id")).first()[0]
    more = global_rank(more, [F.col("fp"), F.col("n")], scratch, "ranked_sets", "rank").withColumn("beyond", F.col("rank") + (top + 1)).select("fp", "n", "beyond")
    return scratch.save(sets.join(more, ["fp", "n"], "left").withColumn("node", F.coalesce("beyond", "id")).drop("beyond"), "all_sets")


def salts(m) -> Column:
    """Parts of a bucket of ``m`` rows: about ``PART`` rows each."""
    return F.ceil(m / PART)


def spread(rows: DataFrame, buckets: DataFrame, parts: Column, *more: str) -> DataFrame:
    """``rows(k, id, ...)`` joined with their bucket by ``k`` and ``more``, a bucket cut into ``parts`` by id.

    The rows of one bucket, which may hold a group of any size, are dealt to several tasks; the bucket's row is copied.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), parts))
    return rows.join(buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1))), ["k", *more, "salt"]).drop("salt")


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(confirm(shingle, percent), "a bigint, b bigint")


def _small_pairs(rows: DataFrame, alike) -> DataFrame:
    """Pairs between components inside small buckets."""
    x, y = rows.select("k", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la")), rows.select("k", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    return x.join(y, "k").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & alike("na", "nb")).select("a", "b")


def _prefix_pairs(rows: DataFrame, texts: DataFrame, shingle: int, percent: int, alike) -> DataFrame:
    """Pairs between components among documents of large buckets that share one of their rarest shingles.

    Two sets of similarity t share a shingle within the first n - ceil(t * n) + 1 of each, in any common order; with
    the rarest first, what many documents share is rarely among these. A prefix row is dropped if what lies at or behind
    it cannot suffice even for the smallest set with that shingle, so a template of many short texts gives no pairs.
    """
    docs = rows.select("id", "label").distinct().join(texts, "id").select("id", "label", "text")
    cells = docs.mapInArrow(explode_set(shingle), "id bigint, label bigint, n bigint, s array<bigint>").select("id", "label", "n", F.explode("s").alias("s"))
    df = cells.join(cells.groupBy("s").agg(F.count("*").alias("df"), F.min("n").alias("least")), "s")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    prefix = df.withColumn("r", rank).where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1))
    behind, other = F.col("n") - F.col("r") + 1, F.greatest("least", F.ceil(F.col("n") * percent / 100))
    prefix = prefix.where(100 * behind >= percent * (F.col("n") + other - behind))
    side = lambda x: prefix.select("s", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("label").alias(f"l{x}"), (F.col("n") - F.col("r") + 1).alias(f"o{x}"))
    # what is common lies at or behind the first common shingle of both orders
    most = F.least("oa", "ob")
    possible = 100 * most >= percent * (F.col("na") + F.col("nb") - most)
    return side("a").join(side("b"), "s").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & alike("na", "nb") & possible).select("a", "b")


def miss_probability(similarity: float, permutations: int = 80, band_rows: int = 5) -> float:
    return (1 - similarity**band_rows) ** (2 * permutations // band_rows)


def prefix_length(n: int, percent: int = 80) -> int:
    return n - ceil(n * percent / 100) + 1
