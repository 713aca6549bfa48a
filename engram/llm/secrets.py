"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Three base patterns give spans that always stay. Wider patterns give candidates: provider tokens, private-key blocks
and long mixed tokens. Every candidate and base value is hashed, and each hash is aggregated over the corpus by distinct
owners and repositories. A candidate within both limits of ``Limits`` is a live-looking credential of its owner and becomes a
span, in however many documents of that owner it stands; a value that many owners or repositories carry is a widely copied
example and adds none. Base spans are counted in both classes but never removed.

Positions are code points, end exclusive. All matches of a pattern come from ``regexp_extract_all`` and the pieces
between them from ``split``; running sums over their lengths give the positions, so work grows with the matches of a
text, not with their square. A hot value (one secret in a third of all documents) meets partially aggregated counts and
an equi-join that adaptive execution can split.

Edge cases: null text counts as empty and has no spans; null repository or owner counts as one more; the join back uses
id and text hash, so repeated rows, and different texts under one id, each get their own answer; an empty table stays
empty; extra columns pass through whatever their names, but one named as ``out`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.common import Scratch, fresh, let


@dataclass(frozen=True)
class Kind:
    """A pattern; the span is the whole match, the value its group ``group``, kept at ``least`` or more characters.

    ``hint``: a cheap test; the pattern runs only on texts that pass it. It must hold wherever the pattern matches.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""
    mixed: bool = False


#: The base kinds. ``hex`` and ``access`` ask for the least length in the pattern, which is the same for
#: maximal runs; ``assign`` drops short values after matching, as a short match also uses up its text.
BASE = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, hint="[:=]"),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18, hint="AKIA"),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Candidates that need ownership evidence. ``mixed``: the value must hold a digit, a small and a capital letter.
WIDE = (
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Kind("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Kind("provider", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", hint="gh._|xox|sk_live_|AIza"),
    Kind("mixed", r"[A-Za-z0-9_-]{24,}", mixed=True),
)
KINDS = (*BASE, *WIDE)
SPAN = "struct<start:bigint,end:bigint,rank:int,kind:string,value:string>"


@dataclass(frozen=True)
class Limits:
    """The most distinct owners and repositories that an owner-specific value has."""

    owners: int = 2
    repos: int = 4


def pieces(text: Column, kind: Kind) -> Column:
    """All matches of one kind, each with the length of the text before it since the last match."""
    none = F.expr("cast(array() as array<struct<gap:int,m:string>>)")
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x))
    cut = F.zip_with(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda m, g: F.struct(g.alias("gap"), m.alias("m")))
    maybe = text.rlike(kind.hint) & text.rlike(kind.pattern) if kind.hint else text.rlike(kind.pattern)
    return F.when(maybe, cut).otherwise(none)


def values(hits: DataFrame, *keys: str) -> DataFrame:
    """One row per match of ``hits``: the keys, rank, ordinal ``i``, gap, match ``m``, its value and whether it is ``good``."""
    rows = hits.select(*keys, F.explode("kinds").alias("x")).select(*keys, "x.rank", F.posexplode("x.ps").alias("i", "p"))
    value, good = F.col("p.m"), F.lit(True)
    for i, kind in enumerate(KINDS):
        mine = F.col("rank") == i
        if kind.group:
            value = F.when(mine, F.regexp_extract("p.m", kind.pattern, kind.group)).otherwise(value)
        good = F.when(mine, F.length("value") >= kind.least if not kind.mixed else F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")).otherwise(good)
    return rows.select(*keys, "rank", "i", "p.gap", "p.m", value.alias("value")).withColumn("good", good)


def digest(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.concat_ws(",", F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, n_owners, n_repos)`` of ``found(value, owner, repo)``.

    Distinct pairs are counted in two steps, each partially aggregated, so a hot value is reduced before it is shuffled.
    """
    found = found.select(F.sha2("value", 256).alias("hash"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("owner", "repo")])
    count = lambda c: found.select("hash", c).distinct().groupBy("hash").agg(F.count("*").alias(f"n_{c}s"))
    return count("owner").join(count("repo"), "hash")


def scan(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", repo: str = "source", owner: Column | None = None, limits: Limits = Limits(), out: str = "secrets") -> DataFrame:
    """``docs`` with a struct column ``out``: spans, base, merged (spans without overlaps), n_owned and n_copied.

    ``owner`` defaults to what stands before the first ``/`` of the repository.
    """
    own = fresh(docs, "_scan")
    t = F.coalesce(F.col(text), F.lit(""))
    owner = F.substring_index(F.col(repo), "/", 1) if owner is None else owner
    kinds = F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), pieces(t, k).alias("ps")) for i, k in enumerate(KINDS)]), lambda x: F.size(x["ps"]) > 0)
    hits = docs.select(F.col(key).cast("string").alias("k"), F.xxhash64(t).alias("h"), F.col(repo).alias("repo"), owner.alias("owner"), kinds.alias("kinds")).where("size(kinds) > 0")
    hits = scratch.save(hits, "hits")
    seen = values(hits, "k", "h", "repo", "owner").where("good").select("value", "owner", "repo")
    counts = scratch.save(ownership(seen).select("hash", ((F.col("n_owners") <= limits.owners) & (F.col("n_repos") <= limits.repos)).alias("owned")), "owners")
    running = Window.partitionBy("k", "h", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = values(hits.dropDuplicates(["k", "h"]), "k", "h").withColumn("end", F.sum(F.col("gap") + F.length("m")).over(running)).where("good")
    spans = spans.withColumn("start", F.col("end") - F.length("m")).withColumn("hash", F.sha2("value", 256)).join(counts, "hash")
    base = F.col("rank") < len(BASE)
    shown = base | F.col("owned")
    # a span opens a merged one if no earlier span reaches beyond its start
    before = F.max(F.when(shown, F.col("end"))).over(Window.partitionBy("k", "h").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("before", before).withColumn("opens", shown & F.coalesce(F.col("start") >= F.col("before"), F.lit(True)))
    kind = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("rank") + 1)
    span = F.struct("start", "end", "rank", kind.alias("kind"), "value")
    back = spans.groupBy("k", "h").agg(
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(F.when(shown, span)).alias("spans"),
        F.sort_array(F.collect_list(F.when(F.col("opens"), F.struct("start", "before")))).alias("opened"),
        F.max(F.when(shown, F.col("end"))).alias("last"),
        F.count(F.when(F.col("owned"), 1)).alias("n_owned"),
        F.count(F.when(~F.col("owned"), 1)).alias("n_copied"),
    )
    merged = F.transform("opened", lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get("opened", i + 1)["before"], "last").alias("end")))
    back = back.select(F.col("k").alias(f"{own}_k"), F.col("h").alias(f"{own}_h"), F.struct("spans", "base", merged.alias("merged"), "n_owned", "n_copied").alias(f"{own}_found"))
    df = docs.withColumn(f"{own}_text", F.xxhash64(t)).join(back, F.col(key).cast("string").eqNullSafe(F.col(f"{own}_k")) & (F.col(f"{own}_text") == F.col(f"{own}_h")), "left")
    no = lambda c, kind: F.coalesce(F.col(f"{own}_found.{c}"), F.expr(kind)).alias(c)
    none = f"cast(array() as array<{SPAN}>)"
    answer = F.struct(no("spans", none), no("base", none), no("merged", "cast(array() as array<struct<start:bigint,end:bigint>>)"), no("n_owned", "0L"), no("n_copied", "0L"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], answer.alias(out))


def redact(text: Column, merged: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span of ``merged`` (in order, without overlaps) replaced by ``mark``.

    Pieces are cut from the text as UTF-32, where a position is an offset.
    """

    def cut(wide: Column) -> Column:
        part = lambda begin, end: F.decode(F.substring(wide, (4 * begin + 1).cast("int"), (4 * (end - begin)).cast("int")), "UTF-32")
        pieces = F.transform(merged, lambda s, i: F.concat(part(F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)), s["start"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(merged, -1)["end"], F.length(text)))

    return F.when(F.size(merged) == 0, text).otherwise(let(F.encode(text, "UTF-32"), cut))
