"""Lookups, sweeps, summaries and injected models."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from engram.functions.models import hash_embedder, with_retry
from engram.operators import episodic, evaluation, lookup, maintenance
from engram.sources.scratch import Scratch

ENT = "id bigint, category string, content string, confidence double, age_hours double, archived boolean, embedding array<float>"


@pytest.fixture
def ents(spark):
    return spark.createDataFrame([(1, "observation", "a b", 0.9, 5000.0, False, [1.0]), (2, "world", "c", 0.5, 900.0, False, [1.0]), (3, "world", "d", 0.0, 900.0, False, None), (4, "world", "e", 0.5, 1.0, None, [1.0, 2.0])], ENT)


def test_sweep_archives_old_and_doubtful(ents):
    assert {r["id"] for r in maintenance.sweep(ents).where("archived").collect()} == {1, 2}


def test_summaries_up_to_the_third_generation(spark, ents):
    say = lambda df: F.concat(F.lit("sum: "), F.col("dialog"))
    one = maintenance.compress(ents, spark.createDataFrame([(7, 1), (7, 2)], "cluster bigint, id bigint"), say)
    r = one.first()
    assert (r["content"], r["compressed_from"], r["generation"], round(r["confidence"], 6)) == ("sum: [observation] a b\n[world] c\n", [1, 2], 1, 0.7)
    two = maintenance.recompress(one, spark.createDataFrame([(9, 7)], "cluster bigint, id bigint"), say).first()
    assert two["generation"] == 2 and two["compressed_from"] == [7]
    with pytest.raises(ValueError):
        maintenance.compress(ents, spark.createDataFrame([(7, 1)], "cluster bigint, id bigint"), say, generation=4)
    again = maintenance.regenerate(one, ents.withColumn("content", F.lit("z")), spark.createDataFrame([(7,)], "cluster bigint"), say).first()
    assert again["content"] == "sum: [observation] z\n[world] z\n"


def test_reembedding_with_an_injected_model(ents):
    r = maintenance.reembed(maintenance.needs_reembedding(ents, 1), hash_embedder(8)).collect()
    assert {x["id"] for x in r} == {3, 4} and all(len(x["embedding"]) == 8 for x in r)
    e = hash_embedder(16)(pd.Series(["a b", "a b", None]))
    assert e[0] == e[1] and set(e[2]) == {0.0}


def test_retry_gives_up_in_the_end():
    calls, pauses = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        with_retry(fails, 4, sleep=pauses.append)()
    assert len(calls) == 4 and pauses == [0.2, 0.4, 0.8]


def test_lookups(spark, ents):
    assert lookup.by_ids(ents, spark.createDataFrame([(1,), (1,), (99,)], "x bigint")).count() == 1
    assert lookup.entity_timeline(ents, F.col("age_hours"), -1).count() == 0
    with pytest.raises(ValueError):
        lookup.provenance(ents)
    good, bad = lookup.validate(ents.withColumn("category", F.when(F.col("id") > 1, F.col("category"))))
    assert good.count() == 3 and bad.count() == 1


def test_percentiles_do_not_interpolate(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0)], "g string, v double")
    assert {r["g"]: (r["p50"], r["p99"]) for r in evaluation.nearest_rank(df, "g", "v", Scratch(spark)).collect()} == {"a": (5.0, 9.0), "b": (5.0, 5.0)}


def test_exports(spark):
    f = spark.createDataFrame([("e", 2, "event", "2", "y"), ("e", 1, "memory", "1", "x")], "episode_id string, frame int, kind string, source_id string, content string")
    assert episodic.export(f).first()["document"] == "[memory] x\n[event] y"
    assert episodic.export(f, "markdown").first()["document"] == "# Episode\n\n- **memory** x\n- **event** y"
    assert episodic.export(f, "json").first()["document"].startswith('[{"frame":1,')
    old = spark.createDataFrame([("e", 1, "cited")], "episode_id string, entity_id bigint, role string")
    new = spark.createDataFrame([("e", 1, "cited"), ("e", 2, "")], "episode_id string, entity_id bigint, role string")
    assert {(r["entity_id"], r["role"]) for r in episodic.link(old, new, ["episode_id", "entity_id"]).collect()} == {(1, "cited"), (2, "extracted")}


def test_selections_bind_what_is_set(spark):
    from engram.operators.lookup import Selection

    df = spark.createDataFrame([(1, "a", True), (2, "b'; DROP", False), (3, "a", None)], "id bigint, name string, flag boolean")
    ids = lambda x: [r["id"] for r in x.build().collect()]
    assert ids(Selection(df).order("id DESC")) == [3, 2, 1]
    assert ids(Selection(df).where_if("name = ?", "").where_if("id = ?", 0).where_if("name = ?", None).order("id")) == [1, 2, 3]
    assert ids(Selection(df).where("name = ?", "b'; DROP")) == [2]
    assert ids(Selection(df).where("id > ? OR name = ?", 2, "a").where_if("flag = ?", False).order("id")) == []
    assert ids(Selection(df).where("id IN (?, ?)", 1, 3).order("id").limit(1)) == [1] and ids(Selection(df).limit(0).order("id")) == [1, 2, 3]
    with pytest.raises(ValueError):
        Selection(df).where("id = ?")
