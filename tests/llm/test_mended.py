"""Cases found in review: links that were lost or false, items without id, bounded samples, linear parsing, cut runs, resumed runs."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import decontaminate, html_extract, langid, mixing, toxicity, urls
from engram.llm.common import Scratch, words
from tests.llm.test_operators import DOCS

B = "http://example.org/es/blocked"
LINKS = [
    (f'<link rel="canonical" title="a > b" href="{B}">', B),
    (f'<link title="it is > so" rel=canonical href="  {B}  ">', B),
    ("<link rel='canonical' href=\"http://example.org/es/it's\">", "http://example.org/es/it's"),
    (f'<meta http-equiv=refresh data-x=a url="http://b.net/" content="0; url={B}">', B),
    (f"<meta content=\"5;URL='{B}'\" http-equiv='Refresh'>", B),
    (f'<!-- <link rel=canonical href="{B}"> -->', None),
    (f'<script>var x = \'<link rel=canonical href="{B}">\';</script>', None),
    (f'<style>/* <link rel=canonical href="{B}"> */</style>', None),
    (f'<link rel="non-canonical" href="{B}">', None),
    (f'<link rel="alternate CANONICAL nofollow" href="{B}">', B),
    (f'<link title="rel=canonical" href="{B}">', None),
    (f'<link data-href="http://x.net/" rel=canonical href={B}>', B),
    (f'<linkage rel=canonical href="{B}">', None),
    (f'<link\nrel\n=\n"canonical"\nhref\n=\n"{B}"\n/>', B),
    (f'<link rel=canonical href="http://example.org/es/a&amp;b">', "http://example.org/es/a&b"),
    (f'<link rel=canonical hreflang="en" href="{B}" href="http://second.net/">', B),
    (f"<link rel=canonical note=it's href={B}>", B),
    (f"<!-- open <link rel=canonical href={B}>", None),
    (f'<meta name=refresh content="0; url={B}">', None),
    (f'<meta http-equiv=refresh content="0; nourl=http://b.net/; url={B}">', None),
]


def test_links_by_hand(spark):
    pages = spark.createDataFrame([(i, f"http://p{i}.net/", html) for i, (html, _) in enumerate(LINKS)], "page_id bigint, url string, html string")
    key = lambda url: url.split("://")[1]
    got = {r["a"]: r["b"] for r in urls.link_edges(pages).collect()}
    assert got == {f"p{i}.net/": key(to) for i, (_, to) in enumerate(LINKS) if to}


def test_tags_of_very_many_attributes_fail_no_job(spark):
    many = " ".join(f'a{i}="x"' for i in range(20_000))
    pages = spark.createDataFrame([(1, "http://p.net/", f'<link {many} rel=canonical href="{B}">'), (2, "http://q.net/", f'<link b="1 > 0" {many} rel=canonical href="{B}">'), (3, "http://r.net/", "<link rel=canonical '" * 3000)], "page_id bigint, url string, html string")
    assert [r["a"] for r in urls.link_edges(pages).where("a = 'p.net/'").collect()] == ["p.net/"]


# decontamination

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion of stars and dust tonight"
BENCH = "item_id bigint, text string"


def test_an_item_without_id_leaks_too(spark):
    docs = spark.createDataFrame([(1, f"before {ITEM} after"), (2, "nothing of the kind " * 9)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, ITEM), (None, None), (5, "some other item that no document here holds in any way at all, not even in part")], BENCH)
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()] == [(1, None)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [2]
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench, part_chars=50).collect()] == [2]


def test_parts_are_bounded_and_hold_every_item(spark):
    rows = [(1, "same text " * 30)] * 200 + [(i, f"item {i} " * (i % 7 + 1)) for i in range(300)]
    bench = spark.createDataFrame(rows, BENCH).repartition(5)
    count, read = decontaminate.parts(bench, "item_id", "text", 1000, Scratch(spark))
    got = list(read)
    longest = max(len(t) for _, t in rows)
    assert sorted(x for p in got for x in p) == sorted(set(rows)) and len(got) <= count
    assert all(sum(len(t) for _, t in p) < 1000 + longest for p in got)
    one, whole = decontaminate.parts(bench, "item_id", "text", 10**9, Scratch(spark))
    assert one == 1 and sorted(next(whole)) == sorted(set(rows))
    none, empty = decontaminate.parts(bench.where("false"), "item_id", "text", 100, Scratch(spark))
    assert none == 1 and list(empty) == []


# language and toxicity samples


def test_the_draw_of_languages_is_bounded_and_alike(spark):
    known = spark.range(6000).select(F.col("id").alias("k"), F.when(F.col("id") < 4000, "en").when(F.col("id") < 5800, "fr").otherwise(F.concat(F.lit("odd"), F.col("id"))).alias("lang"), F.xxhash64("id").alias("h"))
    per = lambda **x: {r["lang"]: r["count"] for r in langid.drawn(known, **x).groupBy("lang").count().collect()}
    assert per(rows=200, languages=2) == {"en": 100, "fr": 100}
    assert per(rows=300, languages=1) == {"en": 300}
    dirty = per(rows=500, languages=50)
    assert len(dirty) == 50 and sum(dirty.values()) <= 500
    assert langid.drawn(known, 200, 2).exceptAll(langid.drawn(known.repartition(7), 200, 2)).count() == 0


def test_the_toxicity_sample_is_bounded_in_features(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{j}" for j in range(400))) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id bigint, toxic int")
    every = toxicity.sample(docs, labels, "doc_id", "text", F.lit(True), 100, 100, 18, 10**9)
    some = toxicity.sample(docs, labels, "doc_id", "text", F.lit(True), 100, 100, 18, 5000)
    assert len(every[0]) == 20 and len(every[1]) == 40
    assert all(0 < x.size.sum() <= 5000 for x in some[:2]) and every[2] == some[2] == 0.5


# HTML


@pytest.mark.parametrize("page", ["<span>" * 30_000 + "</p>" * 30_000, "<div>" * 30_000 + "</section>" * 30_000, "<b><div>" + "<span>" * 30_000 + "</b>" * 30_000, "<iframe>x" * 30_000, "<select>x" * 30_000 + "</select>", "<span>" * 30_000 + "<figure>" * 30_000])
def test_unmatched_tags_cost_no_search(page):
    t = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - t < 10


def test_old_pages_lose_their_footer_and_fields():
    model = html_extract.train(html_extract.labelled_pages())
    page = "<html><body><table><tr><td><h1>Old news of the town</h1><p>The bridge was opened on Monday after a long delay and many speeches.</p><p>People came from far away to see it.</p><fieldset><legend>Search</legend><label>Words</label><input name=q></fieldset></td></tr><tr><td>Copyright 1999</td></tr></table></body></html>"
    assert html_extract.main_text(page, model) == "Old news of the town\n\nThe bridge was opened on Monday after a long delay and many speeches.\n\nPeople came from far away to see it."


# mixing


def test_runs_keep_lines_and_indentation(spark):
    texts = ["  one\ttwo\n\n    three four\n", "a b c", "x", "é  ü\n ö"]
    runs = [[(1, 3)], [(0, 2), (2, 3)], [(0, 1)], [(0, 3)]]
    df = spark.createDataFrame([(t, r) for t, r in zip(texts, runs, strict=True)], "t string, runs array<struct<from:bigint,to:bigint>>")
    assert [r["x"] for r in df.select(mixing.cut_runs(F.col("t"), F.col("runs")).alias("x")).collect()] == [["two\n\n    three"], ["a b", "c"], ["x"], ["é  ü\n ö"]]


def test_mixed_words_are_those_taken(spark):
    rows = [(i, f"\n  line {i}\n    " + " ".join(f"w{i}x{j}" for j in range(i % 9)) + "\n", "en", f"s{i % 3}", 0) for i in range(60)]
    out = mixing.mixed(spark.createDataFrame(rows, DOCS), Scratch(spark)).withColumn("n", F.size(words(F.col("text")))).collect()
    assert out and all(r["n"] == r["taken"] for r in out)


# the pipeline takes up where it ended


def test_a_run_that_died_goes_on_after_its_last_stage(spark, sf, monkeypatch):
    whole = sorted(map(repr, corpus_pipeline.run(spark, sf).collect()))
    done = []

    def counting(name, stage, fails):
        def run(*a):
            if fails:
                raise RuntimeError("lost")
            done.append(name)
            return stage(*a)

        return name, run

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counting(n, f, n == "secrets") for n, f in stages])
    name = f"again-{uuid.uuid4().hex}"
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, sf, name)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counting(n, f, False) for n, f in stages])
    out = corpus_pipeline.run(spark, sf, name)
    assert done == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]
    assert sorted(map(repr, out.collect())) == whole
    Scratch(spark, name).close()
