"""License scan, source divergence and fill-in-middle against brute force, and on hard rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import divergence, infill, licenses
from engram.llm.common import Scratch
from tests.llm.test_operators import DOCS, HARD, hard, nothing  # noqa: F401

# fill-in-middle


def by_characters(text, key, plan=infill.Plan()):
    """The same answer from Python's own strings."""
    text = text or ""
    units = {"char": list(text), "line": re.findall(r"[^\n]*\n|[^\n]+", text), "word": re.findall(r"\A[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|\A[ \t\n\x0b\f\r]+\Z", text)}[plan.unit]
    n = len(units)
    digest = hashlib.sha256(f"{plan.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or h[2] % 100 >= plan.transformed or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = (mark + "".join(part) for mark, part in ((plan.prefix, units[:a]), (plan.middle, units[a:b]), (plan.suffix, units[b:])))
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < plan.suffix_first else (n, "psm", a, b - a, p + s + m)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t<PSM>é 😀ß"), max_size=60), st.integers(0, 10**6), st.sampled_from(infill.UNITS))
def test_masks_equal_plain_strings(text, key, unit):
    plan = infill.Plan(unit=unit)
    assert infill.infill(text, key, plan) == by_characters(text, key, plan)


def test_select_finds_every_set_bit():
    rng = random.Random(5)
    for width in (1, 2, 63, 64, 65, 1000):
        bits = rng.getrandbits(width) | 1
        at = [i for i in range(width) if bits >> i & 1]
        assert [infill.select(bits, width, k) for k in range(len(at))] == at


def test_infill_on_hard_rows_comes_back(spark, hard, nothing):  # noqa: F811
    more = spark.createDataFrame([(100 + i, t, "en", "a", 1) for i, t in enumerate(["a<P>b", "<M>", "<", "<P", "S>", "é" * 5000])], DOCS)
    for unit in infill.UNITS:
        plan = infill.Plan(transformed=100, unit=unit)
        df = infill.transform(hard.select(*DOCS_NAMES).union(more), plan=plan)
        rows = df.withColumn("back", infill.restore(F.col("infill.output"), F.col("infill.form"), plan)).collect()
        assert len(rows) == len(HARD) + 6
        for r in rows:
            assert r["back"] == (r["text"] or "")
            assert tuple(r["infill"]) == by_characters(r["text"], r["doc_id"], plan)
    assert infill.transform(nothing).count() == 0
    clash = infill.transform(hard.withColumn("n", F.lit("x")).withColumn("output", F.lit("y")))
    assert clash.count() == len(HARD) and {r["n"] for r in clash.select("n").collect()} == {"x"}
    assert infill.transform(hard.withColumn("infill", F.lit(1))).columns.count("infill") == 1
    with pytest.raises(ValueError):
        infill.transform(nothing, plan=infill.Plan(unit="page"))


DOCS_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]

# source divergence


def divergence_by_hand(rows, least=3, k=200):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for _, text, lang, source, _ in rows]
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, words in docs:
        groups.add((lang, source))
        df.update({(lang, w) for w in words})
        counts[lang, source].update(words)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in df.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        every = sum((counts[lang, s] for s in sources), Counter())

        def p(c, w, kept=kept):
            return 1 + 10**9 * (c[w] + 1) // (sum(c[t] for t in kept) + len(kept))

        f = lambda a, b: (a - b) ** 2 // b
        table = {s: {w: p(counts[lang, s], w) for w in kept} for s in sources}
        whole = {w: p(every, w) for w in kept}
        for s in sources:
            pairs = [(sum(f(table[s][w], table[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(table[s][w], whole[w]), w) for w in kept if counts[lang, s][w] and table[s][w] > whole[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, k)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def some_documents(seed, n=90):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abéß漢") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    return [(i % 70, " ".join(rng.choice(vocabulary[: 5 + 35 * (i % 3) // 2]) for _ in range(rng.randint(0, 30))).title(), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "", None, "É"]), 0) for i in range(n)]


@pytest.mark.parametrize("k,leaf", [(200, 1024), (3, 1), (7, 2), (1, 1)])
def test_divergence_equals_brute_force(spark, k, leaf):
    rows = some_documents(k)
    got = divergence.audit(spark.createDataFrame(rows, DOCS), Scratch(spark), k=k, leaf=leaf, task_entries=50)
    assert got.count() == len(want := divergence_by_hand(rows, k=k))
    assert {tuple(r) for r in got.collect()} == want


def test_divergence_on_hard_rows(spark, hard, nothing):  # noqa: F811
    got = {tuple(r) for r in divergence.audit(hard, Scratch(spark)).collect()}
    assert got == divergence_by_hand(HARD)
    assert any(part == "pair" and value == 0 for _, _, part, _, value, _ in got)  # a language without kept terms
    empty = divergence.audit(nothing, Scratch(spark))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0


def test_radix_selection_equals_a_sort(spark):
    rng = random.Random(9)
    rows = [(g, "".join(rng.choice("aéz") for _ in range(6)) + str(i), rng.choice([0, 1, 2, 255, 256, 2**31, 2**59, (1 << 63) - 1, rng.randrange(1 << 40)])) for g in (1, 2) for i in range(200)] + [(3, "only", 5)]
    items = spark.createDataFrame(rows, "g int, item string, value bigint")
    for k in (1, 10, 60, 500):
        got = {(r["g"], r["item"], r["value"], r["rank"]) for r in divergence.top(items, ("g",), "item", "value", k, Scratch(spark), leaf=1).collect()}
        want = {(g, i, v, rank) for g in (1, 2, 3) for rank, (v, i) in enumerate(sorted(((v, i) for h, i, v in rows if h == g), key=lambda x: (-x[0], x[1].encode()))[:k], 1)}
        assert got == want


def test_probability_is_exact_for_large_counts(spark):
    rows = [(1, 1), (7, 3_000_000_000_000), (2_999_999_999_999, 3_000_000_000_000), (10**15, 9 * 10**15), (123_456_789, 987_654_321)]
    got = spark.createDataFrame(rows, "c bigint, t bigint").select("c", "t", divergence.probability(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * r["c"] // r["t"] for r in got)


def test_pieces_of_a_long_text_are_all_its_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    for text in (b"", b"   ", b"abcdefghijkl mn op", b"a b c d e f g h i j", b"abcdefghijklmnopq"):
        assert list(itertools.chain.from_iterable(divergence.pieces(text))) == text.split()


# license scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licenses.CAPITALS, licenses.SMALL)))


def scanned_by_hand(text, table=None):
    """Every rule on every text, without keyword or anchor test; containment by comparing all detections."""
    table = licenses.RULES if table is None else table
    w = words_of(text)
    norm = "".join(f" {x} " for x in w)
    base = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in licenses.BASE}
    found = [(norm[: m.start()].count(" ") // 2, norm[: m.end()].count(" ") // 2, i) for i, r in enumerate(table) for m in re.finditer(r.regex, norm)]
    own = sorted(x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and ((y[0], y[1]) != (x[0], x[1]) or y[2] < x[2]) for y in found))
    kept = [x for i, x in enumerate(own) if not (i and own[i - 1][1] > x[0] and own[i - 1][2] < x[2]) and not (i + 1 < len(own) and own[i + 1][0] < x[1] and own[i + 1][2] < x[2])]
    score = max([table[i].weight for _, _, i in kept] + [0.5 if any(base.values()) else 0.0])
    return len(w), {k: (len(v), v[0], v[-1]) for k, v in base.items() if v}, sorted((a, b, table[i].label, table[i].form) for a, b, i in kept), score


TEXTS = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "cc by cc by CC-BY", "according to the account by occ", "GNU GENERAL PUBLIC LICENSE Version 2 or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: MIT",
    "https://creativecommons.org/licenses/by-sa/4.0/ and https://www.apache.org/licenses/LICENSE-2.0", "mit license mit licence MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. All rights reserved.", "dedicated to the public domain", "éapache license", "apache licenseé", "apache license", "x" * 50 + " cc by", "ÀCC BY", "the unlicense",
]


def test_licenses_equal_every_rule_on_every_text(spark):
    rng = random.Random(3)
    parts = [t for t in TEXTS if t] + ["plain words", "by nc 4 0", "under the", "license"]
    texts = TEXTS + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    df = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), Scratch(spark))
    for r in df.collect():
        s = r["licenses"]
        got = s["n_words"], {b["label"]: (b["n"], b["first"], b["last"]) for b in s["base"]}, sorted((x["start"], x["end"], x["label"], x["form"]) for x in s["spans"]), s["score"]
        assert got == scanned_by_hand(r["text"]), r["text"]
        assert s["labels"] == sorted(set(got[1]) | {x[2] for x in got[2]})


def test_what_the_given_license_lines_are_called(spark):
    df = licenses.scan(spark.createDataFrame(list(enumerate(TEXTS[:4])), "doc_id bigint, text string"), Scratch(spark))
    assert [r["licenses"]["labels"] for r in df.orderBy("doc_id").collect()] == [["cc-by", "cc-by-nc-4.0"], ["mit"], ["apache", "apache-2.0"], ["gpl", "gpl-3.0"]]


def test_licenses_on_hard_rows(spark, hard, nothing):  # noqa: F811
    out = licenses.scan(hard, Scratch(spark))
    assert out.count() == len(HARD) and out.columns == [*hard.columns, "licenses"]
    assert {r["licenses"]["n_words"] for r in out.where("doc_id in (1, 2, 3)").collect()} == {0}
    assert licenses.scan(nothing, Scratch(spark)).count() == 0
    same = [(1, "mit license"), (1, "cc by"), (1, "mit license"), (None, "apache license"), (None, None)]
    got = [(r["doc_id"], r["text"], ",".join(r["licenses"]["labels"])) for r in licenses.scan(spark.createDataFrame(same, "doc_id bigint, text string"), Scratch(spark)).collect()]
    assert sorted(got, key=repr) == sorted([(1, "mit license", "mit"), (1, "cc by", "cc-by"), (1, "mit license", "mit"), (None, "apache license", "apache"), (None, None, "")], key=repr)
    clash = licenses.scan(hard.withColumn("licenses", F.lit(1)).withColumn("start", F.lit(1)).withColumn("h", F.lit(2)), Scratch(spark))
    assert clash.count() == len(HARD) and clash.columns.count("licenses") == 1
    long = "word " * 100_000 + "MIT License " * 20_000
    r = licenses.scan(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), Scratch(spark)).first()["licenses"]
    assert (r["n_words"], r["base"][0]["n"], r["base"][0]["first"], r["base"][0]["last"], len(r["spans"])) == (140_000, 20_000, 100_000, 139_998, 20_000)


def test_rules_are_hundreds_and_named_once():
    assert len(licenses.RULES) >= 300
    assert len({(r.form, r.pattern) for r in licenses.RULES}) == len(licenses.RULES)
    assert [list(licenses.FORMS).index(r.form) for r in licenses.RULES] == sorted(list(licenses.FORMS).index(r.form) for r in licenses.RULES)


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_what_a_rule_matches_passes_its_tests(data):
    """Anchors and keywords are necessary for a match, so they lose none."""
    rule = data.draw(st.sampled_from(licenses.RULES))
    text = data.draw(st.from_regex(re.compile(rule.pattern, re.ASCII), fullmatch=True))
    assert any(a in text for a in licenses.ANCHORS) or re.search(licenses.CC, text)
    assert set(rule.keywords) <= set(text.split())
