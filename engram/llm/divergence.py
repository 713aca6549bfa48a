"""Source divergence audit: how the sources of a language differ in their terms, and which terms mark each source.

A language keeps the terms found in at least ``least_docs`` of its documents. A group (language, source), and a language as
a whole, gives a kept term p = 1 + floor(10^9 (count + 1) / (N + V)), with N its occurrences of kept terms and V their
number; f(p, q) = floor((p - q)^2 / q).

1. Tasks count terms by group over batches of documents and hand over (group, term, occurrences, documents), so a frequent
   word or a hot source is summed before it is shuffled. One exchange by (language, term) gives group and language counts.
2. Pairs, sparse and exact: a term absent from a group has its baseline p, which all absent terms share. So the sum of f
   over the V kept terms is V f(baselines), plus a correction for each level of p in either group (levels are few, as rare
   terms share theirs), plus one for each term that both groups have. Only the last is a join by term, of at most one row a
   source.
3. Terms: each group's k-th best is found by radix selection. A value's bits, with its bit length ahead, and then the UTF-8
   bytes of the term form one key; each round is a histogram over the next 16 bits of the key of the items still open in
   their group, and the bucket that holds rank k stays open. Histograms are partially aggregated, so a hot group costs a
   task no more than its 65,536 buckets. A bucket of at most ``leaf`` items is ranked directly.

All arithmetic is in 64-bit integers: p by long division to the base 1,000 (N + V up to 9 * 10^15), sums up to V of 10^9.

Edge cases: null text, language or source is the empty string; every row is a document, repeated rows and ids too; a group
without terms has pairs but no term rows; a language of one source has no pairs, one without kept terms pairs of value 0;
ties go to the lesser UTF-8 bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.common import Scratch

GROUP = ("lang", "source")
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
#: Bytes of terms are letters and all bytes above 0x7F; A-Z are lower-cased, all others separate terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text split at a time.
PIECE = 1 << 20
#: Hexadecimal digits of a radix digit.
DIGIT = 4


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a folded text, some at a time; no term is cut."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = data.rfind(b" ", at, end)
            gap = gap if gap > at else data.find(b" ", end)
            end = gap if gap > 0 else len(data)
        yield data[at:end].split()
        at = end


def count_terms(most: int):
    """For ``mapInArrow``: (lang, source, text) to ``COUNTS``, summed over up to ``most`` entries; a row without term for each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            same = lambda x: pa.array([x] * len(terms), pa.string())
            yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                seen = set()
                for terms in pieces((text.as_py() or b"").translate(FOLD)):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                held += len(n) + 1
                if held > most:
                    yield from flush(found)
                    found, held = {}, 0
        yield from flush(found)

    return run


def probability(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) by long division, for 0 < count <= total."""
    out, rest = F.lit(1).cast("long"), count
    for scale in (1_000_000, 1_000, 1):
        out, rest = out + F.call_function("div", rest * 1000, total) * scale, (rest * 1000) % total
    return out


def gap(p: Column, q: Column) -> Column:
    """f(p, q) = floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def radix_key(value: Column, item: Column) -> Column:
    """Hexadecimal text that sorts as ``value`` descending, then ``item`` by UTF-8 bytes: bit length, bits, bytes."""
    width = F.when(value > 0, F.length(F.bin(value))).otherwise(0)
    room = F.lit(63) - width
    bits = F.call_function("shiftleft", value, room.cast("int"))
    return F.concat(F.lpad(F.hex(room.cast("long")), 2, "0"), F.lpad(F.hex(F.lit((1 << 63) - 1) - bits), 16, "0"), F.hex(F.encode(item, "UTF-8")))


def top(items: DataFrame, group: tuple[str, ...], item: str, value: str, k: int, scratch: Scratch, leaf: int = 1024) -> DataFrame:
    """The ``k`` first rows of each group by ``value`` (not negative) descending, ``item`` ascending, with ``rank`` from 1.

    A group's items are distinct. Each round closes the groups whose open bucket has at most ``leaf`` rows or no more than are
    wanted; the others go on in their bucket, so the open rows shrink and every round reads only what is open.
    """
    rows = items.select(*group, item, value)
    still, closed, i = rows.withColumn("need", F.lit(k)), [], 0
    while True:
        at = F.substring(radix_key(F.col(value), F.col(item)), DIGIT * i + 1, DIGIT)
        still = still.withColumn("digit", at)
        ahead = Window.partitionBy(*group).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        bins = still.groupBy(*group, "need", "digit").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        # the bucket of rank k is the last that begins before it
        pick = bins.where("before < need").groupBy(*[F.col(g).alias(f"g_{g}") for g in group]).agg(F.max(F.struct("digit", "size", "before")).alias("x"))
        same = [F.col(g) == F.col(f"g_{g}") for g in group]
        met = still.join(pick, same).where(F.col("digit") <= F.col("x.digit"))
        left = F.col("need") - F.col("x.before")
        inside = (F.col("digit") == F.col("x.digit")) & (F.col("x.size") > left) & (F.col("x.size") > leaf)
        met = scratch.save(met.select(*group, item, value, left.cast("int").alias("need"), inside.alias("open")), f"radix{i}")
        closed.append(met.where("not open").select(*rows.columns))
        still, i = met.where("open").drop("open"), i + 1
        if still.isEmpty():
            break
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy(*group).orderBy(F.col(value).desc(), F.col(item))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def entries(docs: DataFrame, scratch: Scratch, text: str, lang: str, source: str, least_docs: int, task_entries: int) -> tuple[DataFrame, DataFrame]:
    """(kept entries with p, the language's p as ``q`` and the group's baseline; all groups with baseline and V)."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count_terms(task_entries), COUNTS)
    # one exchange: by language and term lie all sources of a term together, too
    by_group = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    found = by_group.withColumn("keep", F.col("term").isNotNull() & (F.sum("docs").over(term) >= least_docs)).withColumn("lang_n", F.sum("n").over(term))
    found = found.withColumn("head", F.row_number().over(term.orderBy("source")) == 1).where("keep or term is null").drop("docs")
    found = scratch.save(found, "entries")
    kept = found.where("keep")
    per_lang = kept.groupBy("lang").agg(F.count(F.when(F.col("head"), 1)).alias("V"), F.sum("n").alias("lang_total")).select(F.col("lang").alias("l"), "V", "lang_total")
    groups = found.groupBy(*GROUP).agg(F.sum(F.when(F.col("keep"), F.col("n")).otherwise(0)).alias("total")).join(per_lang, F.col("lang") == F.col("l"), "left").drop("l").fillna(0, ["V", "lang_total"])
    one = F.lit(1).cast("long")
    groups = scratch.save(groups.withColumn("base", F.when(F.col("V") > 0, probability(one, F.col("total") + F.col("V"))).otherwise(one)), "groups")
    size = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "total", "V", "lang_total", "base")
    p = probability(F.col("n") + 1, F.col("total") + F.col("V"))
    q = probability(F.col("lang_n") + 1, F.col("lang_total") + F.col("V"))
    scored = kept.join(size, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))).select(*GROUP, "term", p.alias("p"), q.alias("q"), "base")
    return scratch.save(scored, "scored"), groups


def pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the sum of f over all kept terms for each ordered pair of sources of a language."""
    a, b = F.col("base"), F.col("other_base")
    other = groups.select(F.col("lang").alias("l"), F.col("source").alias("other"), F.col("base").alias("other_base"))
    apart = (F.col("lang") == F.col("l")) & (F.col("source") != F.col("other"))
    plain = groups.join(other, apart).select(*GROUP, F.col("other").alias("item"), (F.col("V") * gap(a, b)).alias("value"))
    levels = scored.groupBy(*GROUP, "p", "base").agg(F.count("*").alias("m")).join(other, apart)
    p = F.col("p")
    mine = levels.select(*GROUP, F.col("other").alias("item"), (F.col("m") * (gap(p, b) - gap(a, b))).alias("value"))
    theirs = levels.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), (F.col("m") * (gap(b, p) - gap(b, a))).alias("value"))
    shared = scored.select(F.col("lang").alias("l"), F.col("term").alias("t"), F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("base").alias("other_base"))
    r = F.col("other_p")
    both = scored.join(shared, apart & (F.col("term") == F.col("t"))).select(*GROUP, F.col("other").alias("item"), (gap(p, r) - gap(p, b) - gap(a, r) + gap(a, b)).alias("value"))
    return plain.union(mine).union(theirs).union(both).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, k: int = 200, leaf: int = 1024, task_entries: int = 200_000) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` ranks the other sources of the language by divergence, part
    ``term`` the ``k`` terms with the largest f among those the group has more often than its language."""
    scored, groups = entries(docs, scratch, text, lang, source, least_docs, task_entries)
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    between = pairs(scored, groups).withColumn("rank", F.row_number().over(order))
    marked = scored.where("p > q").select(*GROUP, F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    best = top(marked, GROUP, "item", "value", k, scratch, leaf)
    shape = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return shape(between, "pair").unionByName(shape(best, "term"))
