"""URL filters: prefix rules plus redirect equivalence.

A rule decides the urls of its host and all subdomains whose path starts with the rule's path; the longest rule wins.
Urls without a rule take the decision of their equivalence class: nodes are urls without scheme and fragment, edges
are redirects (``meta refresh``) and canonical links, classes are distributed connected components. A class with an
explicitly blocked url is blocked, unless one of its urls is explicitly allowed: the allow takes precedence. A url's
own rule always stands. Only DataFrame expressions are used.

Every ``link`` and ``meta`` tag of a page counts, whatever its length, unless it stands in a comment or in a script, style,
textarea, title, template or xmp element. A tag ends at its first ``>`` outside quotes (at its first ``>`` if its quotes are
never closed, or if that lies behind more than 500 quoted values); attributes are read in order, each with its own quotes, and
the first of a name counts. A link is canonical if one of the blank-separated words of ``rel`` is; a refresh has its target
behind ``url=`` in ``content``. Character references in values (numeric, and amp, quot, apos, lt, gt) are decoded and values
trimmed; relative targets are resolved against the page, dot segments stay as they are.

Edge cases: a null url or one without ``://`` has empty host and path, matches no rule, has no aliases and is allowed;
null html has no links; repeated rows and repeated links count once per class, and each row gets its verdict; no edges
means no component job at all; extra columns pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import Scratch, connected_components, fresh, let

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no tags: comments and raw elements, up to their end or that of the page.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|xmp)\b[^>]*>.*?(?:</\1\b[^>]*>|\z)"
#: Where a tag that may link begins; its inside if its first ``>`` lies between quotes.
BEGINS = r"(?i)<(?=(?:link|meta)[\s/>])"
QUOTED = r"""(?s)^([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*){0,500})>"""
#: An attribute with its value, read from left to right, so what stands in a value is none.
ATTRIBUTE = r"""(?s)[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Named character references that urls need.
NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def parts(url: Column) -> Column:
    """``struct(host, path, rest)``: rest is everything between host and fragment. Split by position, not by regex."""
    url = F.coalesce(url, F.lit(""))
    tail = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return let(F.substring_index(tail, "#", 1), lambda t: let(
        F.substring_index(F.substring_index(t, "/", 1), "?", 1),
        lambda host: F.struct(
            F.translate(host, CAPITALS, SMALL).alias("host"),
            F.substring_index(t.substr(F.length(host) + 1, F.length(t)), "?", 1).alias("path"),
            t.substr(F.length(host) + 1, F.length(t)).alias("rest"),
        ),
    ))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """``struct(name, verdict)`` of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def decoded(target: Column) -> Column:
    """``target`` with its character references decoded, in one pass over the pieces between ampersands."""

    def piece(p: Column) -> Column:
        number = F.when(p.rlike("^#[0-9]{1,7};"), F.regexp_extract(p, "^#([0-9]+);", 1).cast("int")).when(p.rlike("^#[xX][0-9a-fA-F]{1,6};"), F.conv(F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);", 1), 16, 10).cast("int"))
        rest = p.substr(F.instr(p, ";") + 1, F.length(p))
        sound = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        out = F.when(sound, F.concat(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"), rest))
        for name, mark in NAMED.items():
            out = out.when(p.startswith(name + ";"), F.concat(F.lit(mark), rest))
        return out.otherwise(F.concat(F.lit("&"), p))

    pieces = F.split(target, "&")
    return F.when(F.instr(target, "&") == 0, target).otherwise(F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(piece(p))), ""))


def tags(html: Column) -> Column:
    """The insides of all ``link`` and ``meta`` tags of a page."""

    def inside(rest: Column) -> Column:
        short = F.substring_index(rest, ">", 1)
        loose = F.regexp_replace(short, "\"[^\"]*\"|'[^']*'", "").rlike("[\"']")
        long = F.regexp_extract(rest, QUOTED, 1)
        return F.when(loose & (long != ""), long).otherwise(short)

    pieces = F.split(F.regexp_replace(html, UNREAD, " "), BEGINS, -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), inside)


def attribute(pairs: Column, name: str) -> Column:
    """The decoded, trimmed value of the first attribute of a name among ``name=value`` texts; null if there is none."""
    held = F.get(F.filter(pairs, lambda p: F.lower(F.regexp_extract(p, r"^[^\s=]+", 0)) == name), F.lit(0))
    value = F.regexp_replace(held, r"(?s)^[^=]*=\s*", "")
    bare = F.when(value.rlike("^[\"']"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.regexp_replace(let(bare, decoded), r"^\s+|\s+$", "")


def target(tag: Column) -> Column:
    """Where a tag links to, null if it is neither a canonical link nor a redirect."""

    def read(pairs: Column) -> Column:
        canonical = tag.rlike("(?i)^link") & F.array_contains(F.split(F.lower(attribute(pairs, "rel")), r"\s+"), "canonical")
        refresh = tag.rlike("(?i)^meta") & (F.lower(attribute(pairs, "http-equiv")) == "refresh")
        goal = F.regexp_extract(attribute(pairs, "content"), r"(?is)^[\s\d.]*[\s;,]\s*url\s*=\s*(.*)$", 1)
        within = F.regexp_extract(goal, "(?s)^(?:\"[^\"]*|'[^']*)", 0)
        goal = F.trim(F.when(goal.rlike("^[\"']"), within.substr(F.lit(2), F.length(within))).otherwise(goal))
        return F.when(canonical, attribute(pairs, "href")).when(refresh, goal)

    return let(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), read)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias edges ``(a, b)`` between url keys from all canonical links and redirects; relative targets are resolved."""
    df = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).alias("u"), F.explode(F.transform(tags(F.col(html)), target)).alias("t")).where("t <> ''")
    p, t = parts(F.col("u")), F.col("t")
    here = F.concat(F.lit("http://"), F.col("p.host"))
    full = (
        F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(here, t))
        .when(t.startswith("?"), F.concat(here, F.col("p.path"), t)).otherwise(F.concat(here, F.regexp_replace(F.col("p.path"), "[^/]*$", ""), t))
    )
    df = df.withColumn("p", p).withColumn("q", parts(full))
    return df.select(F.concat("p.host", "p.rest").alias("a"), F.concat("q.host", "q.rest").alias("b")).where("a <> '' and b <> '' and a <> b").distinct()


def judge(pages: DataFrame, edges: DataFrame, scratch: Scratch, url: str = "url", rules: tuple[UrlRule, ...] = RULES, out: str = "judged") -> DataFrame:
    """``pages`` with a struct column ``out``: host, path, rule, verdict and component.

    ``edges(a, b)`` are alias links between url keys (host + path + query), as ``link_edges`` finds them or as a
    crawler recorded them.
    """
    own = fresh(pages, "_judge")
    page, rule, key, alias = (f"{own}_{x}" for x in ("page", "rule", "key", "alias"))
    df = pages.withColumn(page, parts(F.col(url)))
    df = df.withColumn(rule, rule_of(F.col(f"{page}.host"), F.col(f"{page}.path"), rules)).withColumn(key, F.concat(f"{page}.host", f"{page}.rest"))
    edges = scratch.save(edges.select("a", "b"), "edges")
    if edges.isEmpty():
        df = df.withColumn(alias, F.lit(None).cast("struct<component:string,verdict:string>"))
    else:
        cc = scratch.save(connected_components(edges, scratch, "alias"), "aliases")
        p = parts(F.concat(F.lit("x://"), F.col("node")))
        verdicts = cc.withColumn("v", rule_of(p["host"], p["path"], rules)["verdict"]).groupBy("component").agg(F.min("v").alias("verdict"))  # allow sorts before block
        df = df.join(cc.join(verdicts, "component").select(F.col("node").alias(key), F.struct("component", "verdict").alias(alias)), key, "left")
    verdict = F.coalesce(f"{rule}.verdict", f"{alias}.verdict", F.lit("allow"))
    judged = F.struct(F.col(f"{page}.host").alias("host"), F.col(f"{page}.path").alias("path"), F.col(f"{rule}.name").alias("rule"), verdict.alias("verdict"), F.col(f"{alias}.component").alias("component"))
    return df.select(*[F.col(f"`{c}`") for c in pages.columns if c != out], judged.alias(out))
