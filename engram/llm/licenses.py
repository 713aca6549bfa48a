"""License scans by ordered signature rules, in DataFrame operations only.

A text is reduced to its words, each between two blanks of its own, so a rule is a regular expression over words and adjacent
matches never share a blank. Four kinds of rules, in order of priority: passages of license texts, SPDX tags, notices
("licensed under ..."), addresses, and names. Names that come in versions are written once and multiplied out; in all there
are some hundreds of rules. Two tests stand before a rule's regex: a text without any of the anchor stems is not read further,
and a rule is tried only where all its keywords are words of the text.

Detections are intervals of word positions. One inside another goes (of equal ones the rule of higher priority stays); of two
that overlap further, the one of lower priority goes. Positions come from running sums over the words between matches and
containment from a running maximum, so the work grows with the matches of a text, not with their square. Four base phrases
are counted beside the rules and always keep their labels.

Edge cases: null text counts as empty: no words, no detections, score 0; A-Z alone are lower-cased, and every character above
U+007F is part of a word; repeated rows, and different texts under one id, each get their own answer, as the join back uses
id and text hash; an empty table stays empty; extra columns pass through whatever their names, but one named as ``out`` is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.llm.common import Scratch, fresh, let

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, before A-Z are lower-cased; base phrases and their labels.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: A text in which a rule or a base phrase matches contains one of these, or the word cc, once lower-cased.
ANCHORS = ("licen", "spdx", "gpl", "commons", "domain", "permission", "redistrib", "copyleft", "reserved", "warrant", "clause", "cc0", "mozilla", "contributors", "waived", "proprietary", "misrepresent", "gnu")
CC = r"(?<![0-9a-z])cc(?![0-9a-z])"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is over words joined by one blank; it is compiled to words between two blanks each."""

    label: str
    form: str
    pattern: str
    keywords: tuple[str, ...]

    @property
    def regex(self) -> str:
        return f" {self.pattern.replace(' ?', '(?: )?').replace(' ', '  ')} "

    @property
    def weight(self) -> float:
        return FORMS[self.form]


#: Forms by priority, with the score of a detection.
FORMS = {"text": 1.0, "tag": 0.95, "notice": 0.9, "address": 0.85, "name": 0.75}
NOTICE = r"(?:licensed|released|distributed|published|available|provided|issued|covered) (?:for use )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"

#: label | keyword | name | SPDX identifier | address
NAMES = r"""
0bsd | bsd | zero clause bsd(?: licen[cs]e)? | 0bsd |
afl-3.0 | academic | academic free licen[cs]e(?: version)? v?3(?: 0)? | afl 3 0 | opensource org licenses afl 3 0
apache | apache | apache (?:software )?licen[cs]e | |
apache-1.1 | apache | apache (?:software )?licen[cs]e(?: version)? v?1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache | apache (?:software )?licen[cs]e(?: version)? v?2(?: 0)? | apache 2 0 | apache org licenses license 2 0
artistic-2.0 | artistic | artistic licen[cs]e(?: version)? v?2(?: 0)? | artistic 2 0 | opensource org licenses artistic(?: license)? 2 0
beerware | beerware | beerware licen[cs]e | beerware |
beerware | beer | beer ware licen[cs]e | |
bsd | bsd | bsd(?: style)? licen[cs]e | |
bsd-2-clause | bsd | (?:simplified bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?) | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (?:(?:new|revised|modified) bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?) | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:original bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)?|4 clause bsd(?: licen[cs]e)?) | bsd 4 clause |
bsl-1.0 | boost | boost software licen[cs]e(?: version)?(?: v?1 0)? | bsl 1 0 | boost org license 1 0 txt
busl-1.1 | business | business source licen[cs]e(?: 1 1)? | busl 1 1 |
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cddl-1.0 | distribution | common development and distribution licen[cs]e(?: version)?(?: v?1 0)? | cddl 1 0 | opensource org licenses cddl 1 0
cecill-2.1 | cecill | cecill(?: free software)? licen[cs]e(?: agreement)?(?: version)?(?: 2 1)? | cecill 2 1 | cecill info licences licence cecill v2 1
cpl-1.0 | common | common public licen[cs]e(?: version)?(?: v?1 0)? | cpl 1 0 | opensource org licenses cpl1 0
ecl-2.0 | educational | educational community licen[cs]e(?: version)?(?: 2 0)? | ecl 2 0 | opensource org licenses ecl 2 0
elastic-2.0 | elastic | elastic licen[cs]e(?: version)?(?: v?2(?: 0)?)? | elastic 2 0 | elastic co licensing elastic license
epl-1.0 | eclipse | eclipse public licen[cs]e(?: version)? v?1(?: 0)? | epl 1 0 |
epl-2.0 | eclipse | eclipse public licen[cs]e(?: version)? v?2(?: 0)? | epl 2 0 |
eupl-1.2 | european | european union public licen[cs]e(?: version)?(?: v?1 2)? | eupl 1 2 |
gust | gust | gust font licen[cs]e | gust font license |
isc | isc | isc licen[cs]e | isc | opensource org licenses isc
jsl | json | json licen[cs]e | json | json org license html
latex-1.3c | latex | latex project public licen[cs]e(?: version)?(?: 1 3c?)? | lppl 1 3c |
mit | mit | mit licen[cs]e | mit | opensource org licenses mit
mit-0 | mit | mit no attribution licen[cs]e | mit 0 | opensource org licenses mit 0
mpl-1.1 | mozilla | mozilla public licen[cs]e(?: version)? v?1 1 | mpl 1 1 | mozilla org mpl mpl 1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e(?: version)? v?2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0
ms-pl | microsoft | microsoft public licen[cs]e | ms pl | opensource org licenses ms pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms rl | opensource org licenses ms rl
ncsa | illinois | university of illinois(?: ncsa)? open source licen[cs]e | ncsa | opensource org licenses ncsa
odbl-1.0 | database | open (?:data commons open )?database licen[cs]e(?: v?1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0 | data | open data commons attribution licen[cs]e(?: v?1 0)? | odc by 1 0 | opendatacommons org licenses by
ofl-1.1 | sil | sil open font licen[cs]e(?: version)?(?: 1 1)? | ofl 1 1 |
openssl | openssl | openssl licen[cs]e | openssl | openssl org source license html
osl-3.0 | open | open software licen[cs]e(?: version)?(?: v?3 0)? | osl 3 0 | opensource org licenses osl 3 0
pddl-1.0 | domain | (?:open data commons )?public domain dedication and licen[cs]e | pddl 1 0 | opendatacommons org licenses pddl
php-3.01 | php | php licen[cs]e(?: version)?(?: 3 0?1)? | php 3 01 | php net license 3 01 txt
postgresql | postgresql | postgresql licen[cs]e | postgresql | opensource org licenses postgresql
psf-2.0 | python | python software foundation licen[cs]e(?: version)?(?: 2)? | (?:psf|python) 2 0 | docs python org 3 license
public-domain | domain | (?:dedicated to|released into|placed in(?:to)?|in) the public domain | |
qpl-1.0 | public | q public licen[cs]e(?: version)?(?: 1 0)? | qpl 1 0 | opensource org licenses qpl 1 0
ruby | ruby | ruby licen[cs]e | ruby |
sspl-1.0 | side | server side public licen[cs]e(?: version)?(?: v?1(?: 0)?)? | sspl 1 0 | mongodb com licensing server side public license
unicode | unicode | unicode (?:data files and software )?licen[cs]e(?: agreement)? | unicode (?:dfs|3 0|tou) | unicode org license
unlicense | unlicense | the unlicense | unlicense | unlicense org
upl-1.0 | universal | universal permissive licen[cs]e(?: version)?(?: v?1 0)? | upl 1 0 | oss oracle com licenses upl
vim | vim | vim licen[cs]e | vim |
w3c | w3c | w3c software(?: and document)?(?: notice and)? licen[cs]e | w3c |
wtfpl | public | do what the f[a-z]* you want to public licen[cs]e | wtfpl |
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib | opensource org licenses zlib
zpl-2.1 | zope | zope public licen[cs]e(?: version)?(?: 2 1)? | zpl 2 1 |
"""

#: label | keyword | passage
TEXTS = r"""
agpl | affero | you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
all-rights-reserved | reserved | all rights reserved
apache-2.0 | apache | you may not use this (?:file|work|software|document) except in compliance with the licen[cs]e(?: [0-9a-z]+){0,12} apache org licenses license 2 0
artistic | artistic | you may copy and redistribute(?: [0-9a-z]+){0,10} under the artistic licen[cs]e
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither | neither the name of (?:[0-9a-z]+ ){1,12}(?:nor|may) (?:the names of )?(?:its|their)? ?contributors
bsl-1.0 | organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
cc0-1.0 | waived | has waived all copyright and related or neighboring rights
copyleft | copyleft | copyleft (?:licen[cs]e|notice)
gpl | gnu | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
isc | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
lgpl | lesser | you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
mit | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | person | permission is hereby granted free of charge to any person obtaining a copy of this software
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
ofl-1.1 | font | this font software is licensed under the sil open font licen[cs]e
proprietary | proprietary | (?:confidential and proprietary|proprietary and confidential|proprietary licen[cs]e)
public-domain | domain | this (?:work|software|file|code|text|document) is (?:hereby )?(?:in|released into|dedicated to|placed in) the public domain
unlicense | unencumbered | this is free and unencumbered software released into the public domain
zlib | misrepresented | the origin of this software must not be misrepresented
"""

#: Short name, long name and versions; ``version`` patterns allow "v3", "version 3" and "3.0".
GNU = (("gpl", "general public", ("1.0", "2.0", "3.0")), ("lgpl", "(?:lesser|library) general public", ("2.0", "2.1", "3.0")), ("agpl", "affero general public", ("1.0", "3.0")), ("gfdl", "free documentation", ("1.1", "1.2", "1.3")))
CC_TERMS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _lines(table: str) -> list[str]:
    return [line for line in table.strip().split("\n") if line]


def _version(v: str) -> str:
    major, minor = v.split(".")
    return rf"(?: version)? v?{major}{'(?: 0)?' if minor == '0' else f' {minor}'}"


def _split(line: str, fields: int) -> list[str]:
    """Cells of a line, cut at bars between blanks; other bars belong to patterns."""
    cells = [c.strip() for c in f" {line} ".split(" | ")]
    return cells + [""] * (fields - len(cells))


def rules() -> list[Rule]:
    """All rules, highest priority first: by form, then by the order of the tables."""
    found = [Rule(label, "text", pattern, (word,)) for label, word, pattern in (_split(x, 3) for x in _lines(TEXTS))]

    def named(label: str, word: str, name: str, spdx: str = "", address: str = "", address_word: str = "") -> None:
        found.append(Rule(label, "name", name, (word,)))
        found.append(Rule(label, "notice", NOTICE + name, (word,)))
        if spdx:
            found.append(Rule(label, "tag", f"spdx licen[cs]e identifier {spdx}", ("spdx", "identifier")))
        if address:
            found.append(Rule(label, "address", address, (address_word or address.split(" ")[0],)))

    for label, word, name, spdx, address in (_split(x.rstrip("|"), 5) for x in _lines(NAMES)):
        named(label, word, name, spdx, address)
    for short, name, versions in GNU:
        long, path = rf"gnu {name} licen[cs]e", short.replace("gfdl", "fdl")
        named(short, "gnu", long)
        named(short, "gnu", rf"gnu {path}")
        for v in versions:
            spdx = f"{short} {v.replace('.', ' ')}"
            named(f"{short}-{v}", "gnu", long + _version(v), spdx + "(?: only)?", f"gnu org licenses (?:old licenses )?{path} {v.replace('.', ' ')}", "gnu")
            named(f"{short}-{v}", "gnu", rf"gnu {path}" + _version(v))
            found.append(Rule(f"{short}-{v}-or-later", "tag", f"spdx licen[cs]e identifier {spdx} or later", ("spdx", "identifier")))
            named(f"{short}-{v}-or-later", "later", long + _version(v) + r"(?: of the licen[cs]e)? or (?:at your option )?any later version")
    for (terms, name), v in product(CC_TERMS, ("", *CC_VERSIONS)):
        label, number = f"cc-{terms}" + (f"-{v}" if v else ""), f" {v.replace('.', ' ')}" if v else ""
        short = f"cc {terms.replace('-', ' ')}"
        named(label, "commons", f"creative commons {name}{number}(?: (?:international|unported|generic))?(?: (?:public )?licen[cs]e)?", short + number if v else "", f"creativecommons org licenses {terms.replace('-', ' ')}{number}")
        named(label, "cc", short + number)
    return sorted(found, key=lambda r: list(FORMS).index(r.form))


RULES = rules()
SPAN = "struct<start:bigint,end:bigint,label:string,form:string>"


def normal(text: Column) -> Column:
    """Words between two blanks each, " w1  w2 "; empty if there is no word."""
    flat = F.trim(F.regexp_replace(F.translate(text, CAPITALS, SMALL), APART, " "))
    return F.when(flat == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(flat, F.lit(" "), F.lit("  ")), F.lit(" ")))


def word_number(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, APART, " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def counted(text: Column) -> Column:
    """The number of words of a piece of a normal text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("long")


def promising(text: Column) -> Column:
    """Whether a text contains an anchor; all others have no detection and no base phrase."""
    low, hit = F.lower(text), F.lit(False)
    for a in ANCHORS:
        hit = hit | F.contains(low, F.lit(a))
    return hit | low.rlike(CC)


def base_places(text: Column) -> Column:
    """A struct per base phrase that occurs: label, number of places, first and last start in words."""

    def place(norm: Column, phrase: str, label: str) -> Column:
        wide = f" {phrase.replace(' ', '  ')} "
        last = lambda p: (counted(norm) - counted(F.element_at(p, -1)) - len(phrase.split())).alias("last")
        found = let(F.split(norm, wide, -1), lambda p: F.struct(F.lit(label).alias("label"), (F.size(p) - 1).cast("long").alias("n"), counted(p[0]).alias("first"), last(p)))
        return F.when(F.contains(norm, F.lit(wide)), found)

    def places(norm: Column) -> Column:
        return F.filter(F.array(*[place(norm, *x) for x in BASE]), lambda x: x.isNotNull())

    return F.when(promising(text), let(normal(text), places)).otherwise(F.expr("cast(array() as array<struct<label:string,n:bigint,first:bigint,last:bigint>>)"))


def matches(text: Column, table: list[Rule]) -> Column:
    """``(rank, [(words before, words matched)])`` for each rule whose keywords are there and whose regex matches."""
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(r.regex).alias("regex"), F.array(*[F.lit(k) for k in r.keywords]).alias("keywords")) for i, r in enumerate(table)])
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in table for k in r.keywords})])

    def pieces(norm: Column, regex: Column) -> Column:
        gaps = F.transform(F.split(norm, regex, -1), counted)
        cut = F.zip_with(F.regexp_extract_all(norm, regex, F.lit(0)), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda m, g: F.struct(g.alias("gap"), counted(m).alias("n")))
        return F.when(F.regexp_like(norm, regex), cut)

    def tried(norm: Column) -> Column:
        present = F.array_intersect(keywords, F.split(norm, " +"))
        live = let(present, lambda here: F.filter(listed, lambda r: F.forall(r["keywords"], lambda k: F.array_contains(here, k))))
        return F.filter(F.transform(live, lambda r: F.struct(r["rank"], pieces(norm, r["regex"]).alias("ps"))), lambda x: x["ps"].isNotNull())

    return F.when(promising(text), let(normal(text), tried))


def resolved(spans: DataFrame, *keys: str) -> DataFrame:
    """The detections ``(keys, rank, start, end)`` that stay, lower ranks having priority."""
    wide = Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    own = spans.withColumn("before", F.max("end").over(wide)).where("before is null or before < end").drop("before")
    near = Window.partitionBy(*keys).orderBy("start")
    side = lambda step, edge, hit: F.coalesce(hit(step(edge, 1).over(near)) & (step("rank", 1).over(near) < F.col("rank")), F.lit(False))
    loses = side(F.lag, "end", lambda e: e > F.col("start")) | side(F.lead, "start", lambda s: s < F.col("end"))
    return own.withColumn("loses", loses).where("not loses").drop("loses")


def scan(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", table: list[Rule] | None = None, out: str = "licenses") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, base (label, n, first, last per phrase), spans (start and end in words,
    label, form), labels (the rules' and the base phrases', sorted) and score (0 to 1, that of the best detection)."""
    table = RULES if table is None else table
    own = fresh(docs, "_license")
    t = F.coalesce(F.col(text), F.lit(""))
    hits = docs.select(F.col(key).cast("string").alias("k"), F.xxhash64(t).alias("h"), matches(t, table).alias("hits")).where("size(hits) > 0")
    hits = scratch.save(hits, "license_hits").dropDuplicates(["k", "h"])
    rows = hits.select("k", "h", F.explode("hits").alias("x")).select("k", "h", "x.rank", F.posexplode("x.ps").alias("i", "p"))
    running = Window.partitionBy("k", "h", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.select("k", "h", "rank", F.sum(F.col("p.gap") + F.col("p.n")).over(running).alias("end"), F.col("p.n").alias("n")).select("k", "h", "rank", (F.col("end") - F.col("n")).alias("start"), "end")
    kept = resolved(spans, "k", "h")
    fact = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rank") + 1)
    span = F.struct("start", "end", fact([r.label for r in table]).alias("label"), fact([r.form for r in table]).alias("form"))
    back = kept.groupBy(F.col("k").alias(f"{own}_k"), F.col("h").alias(f"{own}_h")).agg(F.struct(F.sort_array(F.collect_list(span)).alias("spans"), F.max(fact([r.weight for r in table])).alias("score")).alias(f"{own}_found"))
    df = docs.withColumns({f"{own}_text": F.xxhash64(t), f"{own}_base": base_places(t), f"{own}_n": word_number(t)})
    df = df.join(back, F.col(key).cast("string").eqNullSafe(F.col(f"{own}_k")) & (F.col(f"{own}_text") == F.col(f"{own}_h")), "left")
    base, found = F.col(f"{own}_base"), F.coalesce(F.col(f"{own}_found.spans"), F.expr(f"cast(array() as array<{SPAN}>)"))
    labels = F.sort_array(F.array_distinct(F.concat(F.transform(base, lambda b: b["label"]), F.transform(found, lambda s: s["label"]))))
    score = F.greatest(F.coalesce(F.col(f"{own}_found.score"), F.lit(0.0)), F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    answer = F.struct(F.col(f"{own}_n").alias("n_words"), base.alias("base"), found.alias("spans"), labels.alias("labels"), score.alias("score"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], answer.alias(out))
