"""The registered queries of the training-data operators, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontaminate, divergence, html_extract, infill, langid, licenses, mixing, neardup, quality, secrets, substrings, toxicity, urls
from engram.llm.common import Scratch, table
from engram.llm.oracles import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality.apply_rules(docs, out="q")
    return q.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    df = secrets.scan(docs, Scratch(spark), out="s")
    count = lambda kind: F.size(F.filter("s.base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.digest(F.col("s.base")), 256).alias("base_sha256"), secrets.digest(F.col("s.spans")).alias("spans"), "s.n_owned", "s.n_copied")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), Scratch(spark), with_text=False)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), Scratch(spark), shingle=2)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    df = urls.judge(pages.select("page_id", "url"), urls.link_edges(pages), Scratch(spark), out="j")
    return df.select("page_id", "j.host", "j.path", "j.rule", "j.verdict")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark), out="s")
    base = F.col("s.base")
    return df.select(
        "doc_id", "s.n_words", F.aggregate(base, F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"), F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
        F.array_join(F.sort_array(F.transform(base, lambda b: b["label"])), ",").alias("base_labels"), F.array_join("s.labels", ",").alias("labels"), "s.score",
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Scratch(spark))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), out="x")
    output, form = F.col("x.output"), F.col("x.form")
    return df.select("doc_id", "x.n", "x.form", F.col("x.prefix_units").alias("prefix_chars"), F.col("x.middle_units").alias("middle_chars"), F.sha2(output, 256).alias("output_sha256"), F.sha2(infill.restore(output, form), 256).alias("restored_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_source_mix, op4_secret_scan, op5_language_id, op6_html_extraction, op7_decontamination, op8_substring_dedup, op9_minhash_dedup, op10_url_filter, op11_license_scan, op12_source_divergence, op13_fill_in_middle)}
