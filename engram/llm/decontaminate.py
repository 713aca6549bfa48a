"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased with white space runs as one space. If a window of ``w`` item characters occurs in a document with
at most ``k`` edits, it shares at least ``w - q + 1 - k * q`` of its q-grams with the document, on at most ``k + 1``
neighbouring diagonals (document position minus item position). So:

1. q-gram hashes of a document are looked up in the index of the benchmark items;
2. hits are counted in diagonal bands of width ``2 * (k + 1)`` that overlap by half, so every alignment of the budget
   lies in one band; a region stays if some window of ``w`` item characters reaches the bound;
3. each window of a retained region is verified by banded alignment with free ends in the document.

Items shorter than ``w`` count as one window with a budget in proportion; items shorter than ``least`` characters
cannot identify a leak and match nothing.

A passage of ``words`` item words that occurs without edits is a leak too, though it may be shorter than ``w``: its
q-grams are one run of hits on one diagonal. It gives a row where no window of the item is found.

The benchmark is split into parts of a bounded number of characters (``part_chars``). One part after another is sent to
the workers, scans all documents and has its result written before the next is read, so neither driver nor workers hold
more than one part, and a larger benchmark costs passes, not memory.

A q-gram that is frequent in texts and items (a line of dashes) has as many hits as the product of its counts. Hits are
therefore looked up in slices of the text, and where a slice is still too large in groups of items; items are indexed in
overlapping segments, so one slice of one segment is bounded. Slices overlap by more than a window, so nothing is lost.

Edge cases: null or empty texts match nothing; an item without id counts, with a null id in the result; repeated documents
each give their own row, a repeated item (same id and text) one; very long texts are scanned whole, in pieces with overlap;
empty tables give an empty result; extra columns are not read, or passed through by ``clean``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.common import Scratch, fresh

MATCHES = "item_id bigint, doc_start bigint, doc_end bigint, edits bigint, coverage double"


@dataclass(frozen=True)
class Budget:
    w: int = 72
    q: int = 8
    k: int = 4
    least: int = 24
    words: int = 13
    piece: int = 1 << 18
    segment: int = 1 << 11
    shared: int = 1 << 9
    hits: int = 1 << 20


def normal(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with single spaces."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    """32-bit hashes of all q-grams; a collision only adds a hit that the alignment rejects."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    h, have, factor = (c ^ (c << np.uint32(7))) * np.uint32(0x9E3779B1), 1, 0x85EBCA6B
    total, done = None, 0
    while True:  # windows of 1, 2, 4, ... characters, put together by the bits of q
        if q & have:
            part = h[done : done + n]
            total = part if total is None else total * np.uint32(pow(factor, have, 1 << 32)) + part
            done += have
        if have * 2 > q:
            break
        h = h[:-have] * np.uint32(pow(factor, have, 1 << 32)) + h[have:]
        have *= 2
    total = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return total ^ (total >> np.uint32(13))


def passages(c: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of that many words starts and ends in a normal text."""
    gap = np.flatnonzero(c == 32)
    at, to = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(c)]])
    return at[: max(len(at) - words + 1, 0)], to[words - 1 :]


def _same(rows: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows."""
    rows = np.ascontiguousarray(rows)
    return np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_inverse=True)[1]


def align(pattern: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern within its band of the text, free ends there, and the first lane that reaches them."""
    n, w = pattern.shape
    lane = np.arange(text.shape[1] - w + 1, dtype=np.int32)
    cost = np.zeros((n, len(lane)), np.int32)
    for i in range(w):
        step = cost + (text[:, i : i + len(lane)] != pattern[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - lane, axis=1) + lane
    best = cost.argmin(axis=1)
    return cost[np.arange(n), best], best


class Index:
    """Sorted q-gram hashes of a part of the benchmark, with a bitmap before them.

    ``chars`` holds segments of items: ``home`` is a segment's item, ``base`` where it starts in the item.
    """

    def __init__(self, items: list[tuple[int, str]], b: Budget):
        self.b, self.ids, self.sizes, self.home, self.base = b, [], [], [], []
        chars, hashes, owner, where = [], [], [], []
        for key, text in items:
            c = normal(text)
            if len(c) < b.least:
                continue
            for at in range(0, max(1, len(c) - b.shared), b.segment - b.shared):
                part = c[at : at + b.segment]
                h = qgrams(part, b.q)
                hashes.append(h)
                owner.append(np.full(len(h), len(chars), np.int64))
                where.append(np.arange(len(h)))
                chars.append(part)
                self.home.append(len(self.ids))
                self.base.append(at)
            self.ids.append(key)
            self.sizes.append(len(c))
        self.chars = chars
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint32)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.where = (np.concatenate(where) if where else np.empty(0, np.int64))[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.hash >> np.uint32(10)] = True
        self.size = np.array([len(c) for c in chars], np.int64)
        self.window = np.minimum(self.size, b.w)
        self.budget = np.where(self.size >= b.w, b.k, np.maximum(self.size * b.k // b.w, 1))
        self.bound = np.maximum(self.window - b.q + 1 - self.budget * b.q, 1)
        self.passages = [passages(c, b.words) for c in chars]
        short = np.array([int((to - at).min()) if len(at) else 1 << 30 for at, to in self.passages], np.int64)
        self.shortest = int(short.min(initial=1 << 30))
        # fewer hits of a segment than this are neither a window nor a passage
        self.need = np.maximum(np.minimum(self.bound, short - b.q + 1), 1)
        self.over = 2 * (b.w + 2 * b.k)

    def hits(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Q-grams of the text that a segment holds: (segment, place in it, diagonal), in bounded pieces.

        Every alignment of a window, or passage shorter than a window, has all its hits in one of the pieces.
        """
        if not len(self.hash):
            return
        h = qgrams(c, self.b.q)
        pos = np.flatnonzero(self.bits[h >> np.uint32(10)])
        lo, hi = np.searchsorted(self.hash, h[pos], "left"), np.searchsorted(self.hash, h[pos], "right")
        total = np.concatenate([[0], np.cumsum(hi - lo)])
        least, cuts = min(self.bound.min(), self.shortest - self.b.q + 1), [(0, len(c))]
        while cuts:
            a, z = cuts.pop()
            x, y = np.searchsorted(pos, [a, z - self.b.q + 1])
            if x >= y or total[y] - total[x] < least:
                continue
            if total[y] - total[x] <= self.b.hits:
                yield self._postings(pos[x:y], lo[x:y], hi[x:y])
            elif z - a > 4 * self.over:
                middle = (a + z) // 2
                cuts += [(middle - self.over // 2, z), (a, middle + self.over // 2)]
            else:  # still too many: groups of segments, whose postings of one hash stand in order
                ranges, count = np.unique(np.stack([lo[x:y], hi[x:y]]), axis=1, return_counts=True)
                per = np.zeros(len(self.chars), np.int64)
                for l, r, n in zip(*ranges.tolist(), count.tolist(), strict=True):  # noqa: E741
                    np.add.at(per, self.owner[l:r], n)
                group = (np.cumsum(per) - per) // self.b.hits
                for g in np.unique(group[per > 0]):
                    first, last = np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right")
                    low = np.array([l + np.searchsorted(self.owner[l:r], first) for l, r in zip(lo[x:y], hi[x:y], strict=True)])  # noqa: E741
                    high = np.array([l + np.searchsorted(self.owner[l:r], last) for l, r in zip(lo[x:y], hi[x:y], strict=True)])  # noqa: E741
                    yield self._postings(pos[x:y], low, high)

    def _postings(self, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = self.where[at]
        return self.owner[at], g, np.repeat(pos, n) - g

    def exact(self, c: np.ndarray, item: np.ndarray, g: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Passages that occur without edits: (item, start in the item, position where it ends, length)."""
        least = max(self.shortest - self.b.q + 1, 1)
        if len(g) < least:
            return
        low, longest = int(diagonal.min()), int(g.max()) + 2
        span = int(diagonal.max()) - low + 1
        key = np.sort((item * span + (diagonal - low)) * longest + g)
        if not (key[least - 1 :] - key[: len(key) - least + 1] == least - 1).any():
            return
        cut = np.flatnonzero(np.diff(key) != 1) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]]) - 1
        for x in np.flatnonzero(last - first + 1 >= least):
            begin, rest = int(key[first[x]]) % longest, int(key[first[x]]) // longest
            i, d, stop = rest // span, rest % span + low, begin + int(last[x] - first[x]) + self.b.q
            at, to = self.passages[i]
            for k in range(np.searchsorted(at, begin), np.searchsorted(to, stop, "right")):
                if np.array_equal(c[at[k] + d : to[k] + d], self.chars[i][at[k] : to[k]]):
                    yield i, int(at[k]), int(to[k]) + d, int(to[k] - at[k])

    def regions(self, item: np.ndarray, g: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows that pass the lemma: (item, window start in the item, diagonal at the left of the band)."""
        if not len(g):
            return (np.empty(0, np.int64),) * 3
        width = self.b.k + 1
        half = diagonal // width
        item, g, band = np.concatenate([item, item]), np.concatenate([g, g]), np.concatenate([half, half - 1])
        # distinct item q-grams of each band, in order; pieces bound the bands, so one integer holds all three
        low = int(half.min()) - 1
        span = int(half.max()) - low + 2
        longest = int(g.max()) + 1
        key = np.sort((item * span + (band - low)) * longest + g)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        g, rest = key % longest, key // longest
        item, band = rest // span, rest % span + low
        end = np.arange(len(g)) + self.bound[item] - 1
        at = np.flatnonzero(end < len(g))
        end = end[at]
        good = (item[end] == item[at]) & (band[end] == band[at]) & (g[end] - g[at] <= self.window[item[at]] - self.b.q)
        at, end = at[good], end[good]
        size = self.size[item[at]]
        # every window that holds the run, not only the one at its first q-gram: edits may precede that
        first = np.maximum(g[end] + self.b.q - self.window[item[at]], 0)
        last = np.minimum(g[at], size - self.window[item[at]])
        # neighbouring runs of one band share windows: each goes on behind the one before
        follows = np.concatenate([[False], (item[at[1:]] == item[at[:-1]]) & (band[at[1:]] == band[at[:-1]])]) if len(at) else np.empty(0, bool)
        first = np.where(follows, np.maximum(first, np.concatenate([[0], last[:-1]]) + 1), first)
        n = np.maximum(last - first + 1, 0)
        start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(item[at], n), start, np.repeat(band[at], n) * width

    def verify(self, c: np.ndarray, item: np.ndarray, start: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window within its band, and the document position where that alignment ends."""
        edits, ends = np.empty(len(item), np.int64), np.empty(len(item), np.int64)
        lanes = 2 * (self.b.k + 1)
        for w in np.unique(self.window[item]).tolist():
            rows = np.flatnonzero(self.window[item] == w)
            for chunk in np.array_split(rows, len(rows) // (1 << 17) + 1):
                windows, p = np.unique((item[chunk] << 32) + start[chunk], return_inverse=True)
                pattern = np.stack([self.chars[x >> 32][x & 0xFFFFFFFF :][:w] for x in windows.tolist()])
                places, t = np.unique(start[chunk] + diagonal[chunk], return_inverse=True)
                at = places[:, None] + np.arange(w + lanes - 1)[None, :]
                text = np.where((at >= 0) & (at < len(c)), c[np.clip(at, 0, len(c) - 1)], np.uint32(0xFFFFFFFF))
                # in repetitive texts most windows are the same: each pair of strings is aligned once
                _, one, back = np.unique(_same(pattern)[p] * len(places) + _same(text)[t], return_index=True, return_inverse=True)
                cost, best = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
                for i in range(0, len(one), 2048):
                    some = one[i : i + 2048]
                    cost[i : i + 2048], best[i : i + 2048] = align(pattern[p[some]], text[t[some]])
                edits[chunk], ends[chunk] = cost[back], places[t] + w + best[back]
        return edits, ends

    def found(self, whole: np.ndarray) -> Iterator[tuple[int, int, int, int, int, bool]]:
        """Windows and passages in the normal text: (item, start in the item, edits, end in the text, length, exact)."""
        for left in range(0, max(1, len(whole) - self.over), self.b.piece):
            c = whole[left : left + self.b.piece + self.over]
            for hits in self.hits(c):
                enough = np.bincount(hits[0], minlength=len(self.chars)) >= self.need
                if not enough.any():
                    continue
                mine = enough[hits[0]]
                hits = tuple(x[mine] for x in hits)
                for i, s, end, w in self.exact(c, *hits):
                    yield self.home[i], s + self.base[i], 0, end + left, w, True
                item, start, diagonal = self.regions(*hits)
                if not len(item):
                    continue
                edits, ends = self.verify(c, item, start, diagonal)
                good = edits <= self.budget[item]
                for i, s, e, end in zip(item[good].tolist(), start[good].tolist(), edits[good].tolist(), ends[good].tolist(), strict=True):
                    yield self.home[i], s + self.base[i], e, end + left, int(self.window[i]), False

    def holds(self, text: str | None) -> bool:
        """Whether any item is found; ends at the first."""
        return next(self.found(normal(text)), None) is not None

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """One entry per item found in the text: (item id, start, end, least edits, share of the item covered)."""
        whole, best = normal(text), {}
        for i, s, edits, end, w, exact in self.found(whole):
            # passages count only where no window of the item is found
            x = best.get(i)
            if x is None or x[4] and not exact:
                x = best[i] = [end - w, end, edits, np.zeros(self.sizes[i] + 1, np.int32), exact]
            elif exact and not x[4]:
                continue
            x[0], x[1], x[2] = min(x[0], end - w), max(x[1], end), min(x[2], edits)
            x[3][s] += 1
            x[3][min(s + w, self.sizes[i])] -= 1
        return [(self.ids[i], max(x[0], 0), min(x[1], len(whole)), x[2], round(float((np.cumsum(x[3])[:-1] > 0).mean()), 4)) for i, x in sorted(best.items())]


def parts(benchmark: DataFrame, key: str, text: str, part_chars: int, scratch: Scratch) -> tuple[int, Iterator[list[tuple[int | None, str]]]]:
    """(number of parts, the parts): the distinct items in parts of about ``part_chars`` characters, each read when the one
    before is done.

    Items are dealt by the running sum of their lengths, so a part exceeds the limit by less than one item; only a sum per
    partition reaches the driver for that. Items without id stay (their id is null), those without text go.
    """
    own = fresh(benchmark.select(key, text), "_deal")
    rows = benchmark.select(key, text).where(F.col(text).isNotNull()).distinct().withColumn(own, F.spark_partition_id())
    rows = scratch.save(rows, "benchmark")
    sums = sorted((r[own], r["n"]) for r in rows.groupBy(own).agg(F.sum(F.length(text)).alias("n")).collect())
    starts = dict(zip((p for p, _ in sums), itertools.accumulate((n for _, n in sums), initial=0), strict=False))
    count = max(1, -(-sum(n for _, n in sums) // part_chars))
    if count > 1:
        before = F.sum(F.length(text)).over(Window.partitionBy(own).orderBy(key, text)) - F.length(text)
        offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col(own))
        rows = scratch.save(rows.withColumn(own, F.floor((offset + before) / part_chars)), "dealt")

    def read() -> Iterator[list[tuple[int | None, str]]]:
        for i in range(count):
            part = rows.where(F.col(own) == i) if count > 1 else rows
            items = [(r[0], r[1]) for r in part.select(key, text).orderBy(key, text).collect()]
            if items:
                yield items

    return count, read()


def _scan(docs: DataFrame, items: list[tuple[int, str]], budget: Budget, key: str) -> DataFrame:
    """``docs(key, text)`` to one row per document and item of this part found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, budget)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in index.matches(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, "item_id", "doc_start", "doc_end", "edits", "coverage"])

    return docs.mapInArrow(run, f"`{key}` bigint, {MATCHES}")


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", budget: Budget | None = None, part_chars: int = 4_000_000) -> DataFrame:
    """One row per document and item found in it: ``(key, item_id, doc_start, doc_end, edits, coverage)``."""
    budget, scratch = budget or Budget(), scratch or Scratch(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], f"`{key}` bigint, {MATCHES}")
    for i, items in enumerate(parts(benchmark, item_key, item_text, part_chars, scratch)[1]):
        out = out.union(scratch.save(_scan(docs.select(F.col(key).cast("bigint"), F.col(text)), items, budget, key), f"part{i}"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, text: str = "text", item_key: str = "item_id", item_text: str = "text", budget: Budget | None = None, part_chars: int = 4_000_000) -> DataFrame:
    """The documents in which no item is found, with all their columns.

    With one part, a filter without a shuffle; otherwise each part writes the numbers of the rows it finds, which are
    taken out at the end.
    """
    budget, scratch = budget or Budget(), scratch or Scratch(docs.sparkSession)

    def keep(items: list[tuple[int, str]], column: int, wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, budget)
            for batch in batches:
                yield batch.filter(pa.array([index.holds(t) == wanted for t in batch.column(column).to_pylist()], pa.bool_()))

        return run

    count, items_of = parts(benchmark, item_key, item_text, part_chars, scratch)
    if count == 1:
        items = next(items_of, [])
        return docs.mapInArrow(keep(items, docs.columns.index(text), False), docs.schema)
    row = fresh(docs, "_row")
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = [scratch.save(rows.select(row, text).mapInArrow(keep(items, 1, True), rows.select(row, text).schema).select(row), f"held{i}") for i, items in enumerate(items_of)]
    for held in found:
        rows = rows.join(held, row, "left_anti")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
