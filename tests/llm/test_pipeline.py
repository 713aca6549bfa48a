"""The corpus pipeline, stage by stage, against the operators' brute-force versions."""

import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import queries
from engram.llm.common import Scratch
from tests.llm.test_operators import brute_components


@pytest.fixture(scope="module")
def stages(spark, sf):
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = scratch.save(stage(spark, docs, sf), name)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]
    assert all(stages[n].columns == stages["input"].columns for n in names[:-1])


def test_quality_keeps_what_the_query_keeps(spark, sf, stages):
    kept = queries.QUERIES["op2_quality_rules"](spark, sf).where("kept")
    assert ids(stages["quality"]) == ids(kept)


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["quality"].collect()]
    want = {c for _, c in brute_components(rows, 5).values()}
    assert ids(stages["near_dedup"]) == want


def test_no_benchmark_passage_is_left(spark, sf, stages):
    flat = lambda t: " ".join((t or "").lower().split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in stages["near_dedup"].collect() if any(i in flat(r["text"]) for i in items)}
    left = ids(stages["decontamination"])
    assert not held & left and held | left == ids(stages["near_dedup"])


def test_secrets_are_replaced_and_the_rest_untouched(stages):
    before = {r["doc_id"]: r for r in stages["decontamination"].collect()}
    after = {r["doc_id"]: r for r in stages["secrets"].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        if r["text"] == before[i]["text"]:
            assert r["n_chars"] == before[i]["n_chars"]
        else:
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
    assert stages["secrets"].where(F.col("text").rlike("[0-9a-f]{16,}")).count() == 0


def test_mix_stays_near_its_targets(stages):
    assert stages["mixing"].columns == [*stages["input"].columns, "size", "source_size", "target", "taken"]
    assert all(len(r["text"].encode().split()) == r["taken"] and r["n_chars"] == len(r["text"]) for r in stages["mixing"].collect())
    got = stages["mixing"].groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert ids(stages["mixing"]) <= ids(stages["secrets"]) and all(abs(r["t"] - r["w"]) <= 0.05 * r["w"] + 2 for r in got)


def test_run_equals_the_stages(spark, sf, stages):
    a, b = (sorted(tuple(r) for r in df.collect()) for df in (corpus_pipeline.run(spark, sf), stages["mixing"]))
    assert a == b and all(x <= y for x, y in itertools.pairwise(a))


HARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n ", "en", None, 3), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3), (6, "word " * 30_000, "en", "a", 150_000),
    (7, "a b c d e f g", "fr", "c", 13), (7, "a b c d e f g", "fr", "c", 13), (None, "token=abcdefabcdefabcdef", None, "c", 10),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_hard_rows(spark, sf, name, stage):
    docs = spark.createDataFrame(HARD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("id", "k", "m", "size", "rank", "spans", "kept", "_quality", "_secrets", "_text", "_k", "_h", "_a", "_row", "_scan_k", "component", "node"):  # names that clash with internals
        docs = docs.withColumn(c, F.lit("x"))
    got = stage(spark, docs, sf).collect()
    want = {"quality": 0, "near_dedup": 8, "decontamination": 9, "secrets": 9}.get(name)
    assert want is None or len(got) == want
    if name == "near_dedup":
        assert sorted(r["doc_id"] for r in got if r["doc_id"]) == [1, 2, 3, 4, 6, 7, 7]
    if name == "secrets":
        assert [r["text"] for r in got if r["doc_id"] is None] == ["[SECRET]"] and all(r["id"] == "x" for r in got)
    if name == "mixing":
        assert all(0 < r["taken"] <= 2 * r["size"] for r in got)
    assert stage(spark, docs.where("false"), sf).count() == 0
