"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. A document's size is its number of words. Sources, in code-point order with null last, take the weights in turn;
   targets share ``total_share`` of all words by weight, no target above ``cap`` times its source (water filling).
2. Equal-token blocks are the seats: sources receive them by the highest quotients target / (2k - 1).
3. Each source is laid out in seeded order and cut into shards of ``shard_rows`` documents; its seats are apportioned to
   its shards by the same rule within the shards' limits, giving integer quotas per shard.
4. A shard cuts its documents into blocks of equal length. A quota of q seats over m blocks takes every block q // m
   times and q % m blocks, a seeded run of the order, once more.

A source, or copies of one row, may be most rows: only shards are ever gathered, and the positions that define them come
from range partitions in which a row number separates equal rows. Seats are bounded below and above in closed form, so
only about two quotients per party are compared, whatever the number of blocks.

Edge cases: null or blank texts have size 0 and take nothing; a source of size 0 has target 0; ties between quotients
go to the earlier source or shard; repeated rows and ids are separate documents; an empty table gives an empty result;
extra columns pass through ``mixed`` (those named as one of its four figures are replaced) and are not read by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.common import Scratch, fresh, global_rank, let, word_count, words


def water_fill(sources: DataFrame, total: float, cap: float, scratch: Scratch) -> DataFrame:
    """``sources(source_size, weight, ...)`` with ``target``: shares of ``total`` by weight, capped, excess reshared.

    Each round caps every source above its limit and reshares the rest; two scalars per round reach the driver.
    """
    limit = F.col("source_size") * F.lit(float(cap))
    level = 0.0
    while True:
        s = sources.agg(F.sum(F.when(limit > F.col("weight") * level, F.col("weight"))).alias("w"), F.sum(F.when(limit <= F.col("weight") * level, limit)).alias("used")).first()
        if not s["w"]:
            break
        nxt = (total - float(s["used"] or 0.0)) / float(s["w"])
        if nxt <= level:
            break
        level = nxt
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def apportion(parties: DataFrame, group: Sequence[str], claim: str, seats: str, tie: Sequence[str], scratch: Scratch, name: str, most: str | None = None) -> DataFrame:
    """Sainte-Lague seats as by ``_apportion``; no party above its ``most``.

    Parties beyond their limit stay there and the others share the seats that are left, until none is beyond. Seats that
    no party may take are not dealt.
    """
    out = _apportion(parties, group, claim, seats, tie, scratch, name)
    if most is None:
        return out
    out, i = scratch.save(out, f"{name}_dealt"), 0
    while not out.where(F.col("quota") > F.col(most)).isEmpty():
        i += 1
        full = out.where(F.col("quota") >= F.col(most)).withColumn("quota", F.col(most).cast("long"))
        used = full.groupBy(*[F.col(g).alias(f"_u_{g}") for g in group]).agg(F.sum("quota").alias("_used"))
        rest = out.where(F.col("quota") < F.col(most)).join(used, on=[F.col(g).eqNullSafe(F.col(f"_u_{g}")) for g in group], how="left") if group else out.where(F.col("quota") < F.col(most)).crossJoin(F.broadcast(used))
        rest = rest.withColumn("_left", F.col(seats) - F.coalesce("_used", F.lit(0))).select(*parties.columns, "_left")
        again = _apportion(rest, group, claim, "_left", tie, scratch, f"{name}_again{i}")
        out = scratch.save(full.select(*parties.columns, "quota").unionByName(again.select(*parties.columns, "quota")), f"{name}_dealt{i}")
    return out


def _apportion(parties: DataFrame, group: Sequence[str], claim: str, seats: str, tie: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """Sainte-Lague seats for ``parties``: per ``group``, ``seats`` (a column) are dealt by the quotients claim/(2k-1).

    With q = claim / sum * seats and n parties, rounding at the divisors sum/(seats - n/2) and sum/(seats + n/2) gives
    too few and too many seats in total, hence a lower and an upper bound for each party. The quotients between them
    compete for what the lower bounds leave.
    """
    totals = parties.groupBy(*group).agg(F.sum(claim).alias("_sum"), F.sum(F.when(F.col(claim) > 0, 1).otherwise(0)).cast("double").alias("_n"))
    df = parties.join(totals.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_sum", "_n"), on=[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], how="inner").drop(*[f"_g_{g}" for g in group]) if group else parties.crossJoin(F.broadcast(totals))
    h, n, v = F.col(seats).cast("double"), F.col("_n"), F.col(claim).cast("double")
    share = F.when(F.col("_sum") > 0, v / F.col("_sum")).otherwise(0.0)
    low = F.greatest(F.floor(share * (h - n / 2) + 0.5) - 1, F.lit(0)).cast("long")
    high = F.when(v > 0, (F.floor(share * (h + n / 2) + 0.5) + 1).cast("long")).otherwise(F.lit(0).cast("long"))
    df = scratch.save(df.withColumn("_low", low).withColumn("_high", F.greatest(high, low)), f"{name}_bounds")
    given = df.groupBy(*group).agg(F.sum("_low").alias("_given"), F.first(seats).alias("_seats"))
    key = [*group, *tie]
    rivals = df.where("_high > _low").select(*[F.col(k) for k in key], v.alias("_v"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k")).withColumn("_quotient", F.col("_v") / (2 * F.col("_k") - 1))
    order = [*[F.col(g).asc_nulls_last() for g in group], F.col("_quotient").desc(), *[F.col(t).asc_nulls_last() for t in tie], F.col("_k")]
    ranked = scratch.save(global_rank(rivals, order, scratch, f"{name}_rivals", "_rank"), f"{name}_ranked")
    first = ranked.groupBy(*group).agg(F.min("_rank").alias("_first"))
    rest = given.join(first, on=_same(given, first, group)) if group else given.crossJoin(first)
    rest = rest.select(*[given[g].alias(f"_g_{g}") for g in group], (F.col("_seats") - F.col("_given") + F.col("_first")).alias("_until"))
    won = ranked.join(rest, on=[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]) if group else ranked.crossJoin(F.broadcast(rest))
    won = won.where("_rank < _until").groupBy(*key).agg(F.count("*").alias("_won")).select(*[F.col(k).alias(f"_k_{k}") for k in key], "_won")
    out = df.join(won, on=[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], how="left")
    return out.withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop(*[f"_k_{k}" for k in key], "_won", "_low", "_high", "_sum", "_n")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def laid_out(docs: DataFrame, scratch: Scratch, key: str, text: str, source: str, row: str, weights: Sequence[float], total_share: float, cap: float, block: int, shard_rows: int, seed: int) -> DataFrame:
    """Per row of ``docs``: ``(row, key, size, source_size, target, taken, turns, runs)``.

    ``turns`` is how often the whole document is taken, ``runs`` are the word ranges (from, to) taken once more. ``row``
    is a column that is different in every row; it only separates equal rows.
    """
    order = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")))
    sized = scratch.save(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order.alias("seeded"), F.col(row).alias("row")), "sized")
    per = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    whole = per.agg(F.sum("source_size").alias("n"), F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).alias("least")).first()
    none = F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)")
    zero = F.lit(0).cast("long")
    if not whole["n"]:
        rows = sized.join(per.select(F.col("source").alias("_s"), "source_size"), F.col("source").eqNullSafe(F.col("_s")))
        return rows.select("row", "key", "size", "source_size", F.lit(0.0).alias("target"), zero.alias("taken"), zero.alias("turns"), none.alias("runs"))
    total, step = total_share * whole["n"], max(1, min(block, whole["least"] // 64))
    ranked = global_rank(per, [F.col("source").asc_nulls_last()], scratch, "ranked_sources", "rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    targets = scratch.save(water_fill(scratch.save(ranked.withColumn("weight", turn), "weighted"), total, cap, scratch), "targets")
    seats = F.lit(int(total / step + 0.5)).cast("long")
    quotas = scratch.save(apportion(targets.withColumn("all_seats", seats), (), "target", "all_seats", ("rank",), scratch, "by_source").select("source", "source_size", "target", F.col("quota").alias("source_quota")), "quotas")
    # shards: runs of shard_rows positions in seeded order, so that copies of one row are dealt to many
    placed = global_rank(sized, [F.col("source").asc_nulls_last(), F.col("seeded"), F.col("key"), F.col("row")], scratch, "placed", "position")
    placed = scratch.save(placed.withColumn("shard", F.floor(F.col("position") / shard_rows)), "shards")
    scratch.drop("placed")
    m = F.greatest(F.round(F.col("shard_size") / step), F.lit(1)).cast("long")
    sums = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).withColumn("m", m).withColumn("most", F.floor(F.col("m") * F.lit(float(cap))))
    q = quotas.select(F.col("source").alias("_s"), "source_size", "target", "source_quota")
    sums = sums.join(q, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    dealt = apportion(sums, ("source",), "shard_size", "source_quota", ("shard",), scratch, "by_shard", "most")
    dealt = scratch.save(dealt.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "m", "quota", "source_size", "target"), "shard_quotas")
    df = placed.join(dealt, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h")
    w = Window.partitionBy("source", "shard").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("end", F.sum("size").over(w)).withColumn("start", F.col("end") - F.col("size"))
    # m blocks of shard_size / m words; quota = every block `turns` times and a seeded run of `extra` blocks once more
    df = df.withColumn("turns", F.floor(F.col("quota") / F.col("m"))).withColumn("extra", F.col("quota") % F.col("m"))
    df = df.withColumn("b0", F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), F.col("m"))).withColumn("b1", F.col("b0") + F.col("extra"))
    edge = lambda b: F.floor(b * F.col("shard_size") / F.col("m"))
    inside = lambda x: F.greatest(F.least(x, F.col("end")), F.col("start")) - F.col("start")
    run = lambda lo, hi: F.struct(inside(lo).alias("from"), inside(hi).alias("to"))
    runs = F.array(run(zero, edge(F.greatest(F.col("b1") - F.col("m"), zero))), run(edge(F.col("b0")), edge(F.least("b1", "m"))))
    df = df.withColumn("runs", F.filter(runs, lambda r: r["from"] < r["to"])).withColumn("turns", F.when(F.col("size") == 0, zero).otherwise(F.col("turns")))
    taken = F.col("turns") * F.col("size") + F.aggregate("runs", zero, lambda n, r: n + r["to"] - r["from"])
    return df.select("row", "key", "size", "source_size", "target", taken.cast("long").alias("taken"), "turns", "runs")


def mix(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, cap: float = 2.0, block: int = 256, shard_rows: int = 4096, seed: int = 42) -> DataFrame:
    """One row per document: ``(key, size, source_size, target, taken, turns, runs)``; ``taken`` counts repeats.

    ``block`` is the largest block length in words; it shrinks to a 64th of the smallest non-empty source, so that
    small sources meet their targets too. The result depends on the data and ``seed`` alone.
    """
    row = fresh(docs, "_row")
    rows = docs.select(key, text, source).withColumn(row, F.monotonically_increasing_id())
    out = laid_out(rows, scratch, key, text, source, row, weights, total_share, cap, block, shard_rows, seed)
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken", "turns", "runs")


def cut_runs(text: Column, runs: Column) -> Column:
    """The pieces of ``text`` from the first to the last character of each run of words (from, to)."""
    blanks = r"[\x20\x09-\x0D]+"
    zero = F.lit(0).cast("long")
    span = lambda x, n: F.aggregate(F.slice(x, 1, n.cast("int")), zero, lambda a, w: a + F.length(w))

    def pieces(both: Column) -> Column:
        w, gaps = both["w"], both["gaps"]
        begin = lambda k: span(w, k) + span(gaps, k + 1)
        end = lambda k: span(w, k) + span(gaps, k)
        return F.transform(runs, lambda r: F.substring(text, (begin(r["from"]) + 1).cast("int"), (end(r["to"]) - begin(r["from"])).cast("int")))

    # gaps[i] stands before word i; both arrays are read off one text
    lead = F.regexp_extract(text, "^" + blanks, 0)
    inner = F.filter(F.regexp_extract_all(text, F.lit(blanks), F.lit(0)), lambda g: g != "")
    gaps = F.when(lead == "", F.concat(F.array(F.lit("")), inner)).otherwise(inner)
    return let(F.struct(words(text).alias("w"), gaps.alias("gaps")), pieces)


def mixed(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: ``docs`` with the words taken as ``text``, and ``size, source_size, target, taken``.

    A document taken whole appears as often, its copies joined by two line ends; a run of further words follows as it stands
    in the text, lines and indentation between its words included. Documents of which nothing is taken go.
    """
    row = fresh(docs, "_row")
    plan = dict(weights=(3, 1, 2), total_share=1.5, cap=2.0, block=256, shard_rows=4096, seed=42) | options
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = laid_out(rows, scratch, key, text, source, row, **plan).where("taken > 0")
    figures = ["size", "source_size", "target", "taken"]
    df = rows.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), F.col(row).alias("row")).join(found, "row")
    own = F.col(f"doc.`{text}`")
    none = F.expr("cast(array() as array<string>)")
    parts = F.concat(F.array_repeat(own, F.col("turns").cast("int")), F.when(F.size("runs") == 0, none).otherwise(cut_runs(own, F.col("runs"))))
    return df.select(*[F.array_join(parts, "\n\n").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in figures], *figures)
