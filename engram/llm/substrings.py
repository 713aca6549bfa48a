"""Substring dedup by de Bruijn compaction within minimizers.

A window of ``k`` words is an edge of the de Bruijn graph from its first to its last ``k - 1`` words. Consecutive
edges of a document with one minimizer (the least hash among the windows' m-word pieces) form a path. Equal windows have
equal minimizers, so all occurrences of an edge lie in paths of one minimizer, and whether a path branches is decided
inside its minimizer's group: there is no table of all nodes with their degrees.

1. Paths, a fifth as many as windows, are aggregated by minimizer: least and greatest document, least and greatest
   content hash. A minimizer of a single document ends here.
2. A join brings the aggregate back to the paths. Where every occurrence has the same content the path does not branch:
   it is one compacted repeat, and its coordinates (document, start, length) are marked in all but the least document.
3. Paths that branch are opened into their distinct windows; each window hash gets its least document by a second
   aggregate and join.
4. Marks are gathered per text. Each compacted repeat is verified at its coordinates: the words found there must have the
   content hash of the path. The kept words are written out.

Minimizer and content are independent 64-bit hashes of the words, so two paths are taken for equal by 128 bits; windows of
branching paths by 64.

Every step is a partially aggregated minimum or an equi-join, so a passage in a third of all documents is one group of
an aggregate and a skewed join side that adaptive execution splits. Nothing is cut to fixed counts: paths longer than
``LONGEST`` windows go on as the next path.

Edge cases: null or blank text has no words; a text shorter than a window keeps everything; a window repeated only
inside its document stays; rows with a null id own and lose nothing; rows that repeat an id are parts of one document,
each with its own coordinates (marks are gathered by id and a hash of the text; where two texts of an id share that
hash, step 4 tells their marks apart); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import Scratch
from engram.llm.shingles import Texts, finish, split_words, window_hash

#: Coordinates of a path in one integer: start, 24 bits of the text's hash, number of windows.
TAG_BITS, COUNT_BITS = 24, 9
LONGEST = (1 << COUNT_BITS) - 1
#: Stands for a null id, so that every use of the texts has one plan; owns and loses nothing.
NO_ID = -(2**63)


def paths(k: int, m: int):
    """For ``mapInArrow``: (id, tag, text) to (minimizer, id, coordinates, content hash) for each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, width = Texts(), k - m + 1
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for row, w, bounds in texts.groups(batch.column(2)):
                n = len(w) - k + 1
                if n <= 0:
                    continue
                least, have = window_hash(w, m), 1
                while have < width:  # a sliding minimum by doubling
                    step = min(have, width - have)
                    least = np.minimum(least[:-step], least[step:])
                    have += step
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                whole = (doc[:n] == doc[k - 1 :]) & (ids[row + doc[:n]] != NO_ID)  # windows inside one document
                cut = np.flatnonzero((least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1]) | (whole[1:] != whole[:-1])) + 1
                start = np.concatenate([[0], cut])
                count = np.diff(np.concatenate([start, [n]]))
                start, count = start[whole[start]], count[whole[start]]
                if len(count) and count.max() > LONGEST:
                    parts = -(-count // LONGEST)
                    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    start, count = np.repeat(start, parts) + nth * LONGEST, np.minimum(np.repeat(count, parts) - nth * LONGEST, LONGEST)
                own = row + doc[start]
                at = ((start - bounds[doc[start]]) << (TAG_BITS + COUNT_BITS)) | (tags[own] << COUNT_BITS) | count
                yield pa.RecordBatch.from_arrays([pa.array(least[start].view(np.int64)), pa.array(ids[own]), pa.array(at), pa.array(path_hash(texts, w, start, count, k).view(np.int64))], ["mz", "id", "at", "content"])

    return run


def path_hash(texts: Texts, w: np.ndarray, start: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Content hashes of paths of ``count`` windows."""
    return finish(texts.word_powers.spans(w, start, start + count + k - 1) ^ count.astype(np.uint64))


class Marks:
    """A column of marks, row by row: (starts, counts, content hashes) of straight paths and (starts, counts) of open ones."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        self.at = flat.field(0).to_numpy(zero_copy_only=False)
        self.content = flat.field(1).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(size)
        self.begins = self.ends - size

    def straight(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, content = self.at[self.begins[row] : self.ends[row]], self.content[self.begins[row] : self.ends[row]]
        return at[at >= 0] >> (TAG_BITS + COUNT_BITS), at[at >= 0] & LONGEST, content[at >= 0]

    def open(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[self.begins[row] : self.ends[row]]
        at = ~at[at < 0]
        return at >> (TAG_BITS + COUNT_BITS), at & LONGEST


def open_windows(w: np.ndarray, start: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows of a text's open paths, in order."""
    at = np.unique(np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    h = window_hash(w, k)
    at = at[at < len(h)]
    return at, h[at]


def windows(k: int):
    """For ``mapInArrow``: (id, tag, text, marks) to the distinct (window hash, id, tag) of open paths; a repetitive text has few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts()
        for batch in batches:
            marks, hashes, rows = Marks(batch.column(3)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, w in enumerate(texts.rows(batch.column(2))):
                h = np.unique(open_windows(w, *marks.open(i), k)[1])
                hashes.append(h.view(np.int64))
                rows.append(np.full(len(h), i, np.int64))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), batch.column(0).take(at), batch.column(1).take(at)], ["h", "id", "tag"])

    return run


def kept_words(k: int, with_text: bool):
    """For ``mapInArrow``: (id, text, marks, owned hashes) to (id, words, removed, hash of the kept words, kept text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts()
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            marks = Marks(batch.column(2))
            for i, (text, w, late) in enumerate(zip(batch.column(1).to_pylist(), texts.rows(batch.column(1)), batch.column(3).to_pylist(), strict=True)):
                words, n = split_words(text), len(w)
                start, count, content = marks.straight(i)
                if (len(start) or late) and n:
                    fits = start + count + k - 1 <= n
                    start, count, content = start[fits], count[fits], content[fits]
                    same = path_hash(texts, w, start, count, k) == content
                    spots = np.empty(0, np.int64)
                    if late:
                        at, h = open_windows(w, *marks.open(i), k)
                        spots = at[np.isin(h.view(np.int64), np.array(late, np.int64))]
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, np.concatenate([start[same], spots]), 1)
                    np.add.at(step, np.concatenate([start[same] + count[same] + k - 1, spots + k]), -1)
                    words = [words[x] for x in np.flatnonzero(np.cumsum(step)[:n] == 0).tolist()]
                kept = b" ".join(words)
                out[0].append(n)
                out[1].append(n - len(words))
                out[2].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out[3].append(kept)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: 4 + with_text], COLUMNS[: 4 + with_text])

    return run


COLUMNS = ["id", "n_words", "n_removed", "kept_sha256", "kept_text"]


def dedup(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", k: int = 13, m: int = 5, with_text: bool = True, tag_bits: int = TAG_BITS) -> DataFrame:
    """One row per document: ``(key, n_words, n_removed, kept_sha256)``, and ``kept_text`` if it is wanted.

    ``tag_bits`` (24 at most) of a text's hash tell rows of one id apart. A word is removed if a window over it also starts in a document with a smaller id. The marks of shared paths are
    written to scratch; what follows is one query, in which all uses of the texts by id read one exchange.
    """
    docs = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text)).bitwiseAND((1 << tag_bits) - 1).alias("tag"), F.col(text).alias("text"))
    path = docs.mapInArrow(paths(k, m), "mz bigint, id bigint, at bigint, content bigint")
    groups = path.groupBy("mz").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    shared = groups.where("first < last").select("mz", "first", (F.col("c0") == F.col("c1")).alias("straight"))
    found = path.join(shared, "mz").where("not straight or id > first")
    # a compacted repeat is marked by its coordinates and content, an open path by the complement of its coordinates
    mark = F.struct(F.when(F.col("straight"), F.col("at")).otherwise(F.bitwise_not("at")).alias("at"), F.when(F.col("straight"), F.col("content")).alias("content"))
    tag = F.shiftright("at", COUNT_BITS).bitwiseAND((1 << TAG_BITS) - 1)
    marks = scratch.save(found.groupBy("id", tag.alias("tag")).agg(F.collect_set(mark).alias("marks")), "marks")
    marked = docs.join(marks, ["id", "tag"])
    edges = marked.where(F.exists("marks", lambda x: x["at"] < 0)).select("id", "tag", "text", "marks").mapInArrow(windows(k), "h bigint, id bigint, tag bigint")
    owners = edges.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "first")
    late = edges.join(owners, "h").where("id > first").groupBy("id", "tag").agg(F.collect_set("h").alias("late"))
    final = docs.join(marks, ["id", "tag"], "left").join(late, ["id", "tag"], "left").select("id", "text", "marks", "late")
    schema = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    out = final.mapInArrow(kept_words(k, with_text), schema)
    return out.select(F.nullif("id", F.lit(NO_ID)).alias(key), *COLUMNS[1 : 4 + with_text])
