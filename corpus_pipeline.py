"""From raw documents to a mixed training corpus, in five stages.

Every stage takes the documents its predecessor kept; ``run`` writes each result as Parquet to the shared scratch folder
and reads it again, so no stage depends on the lineage of another.

1. quality: documents that fail the base test or a rule of the threshold table go.
2. near_dedup: of each component of near copies (five-word shingles, similarity 0.8) the least id stays.
3. decontamination: documents that hold a benchmark passage go.
4. secrets: base spans and owner-specific credentials are replaced by a mark; all documents stay.
5. mixing: the mixed text of each document, repeats written out, with size, source_size, target and words taken;
   documents of which nothing is taken go.

Null, empty and blank texts fail the base test and leave at the first stage; a later stage that is given one keeps it (the
mix takes nothing of it, so it goes there). Rows that repeat an id count as one document and stay or go together; rows
with a null id are never near copies. Ties go to the least id. Empty tables stay empty; other columns
pass through whatever their names, but at the last stage those named as one of its four figures are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontaminate, mixing, neardup, quality, secrets
from engram.llm.common import Scratch, fresh, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = fresh(docs, "_quality")
    return quality.apply_rules(docs, out=own).where(F.col(own)["kept"]).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = neardup.components(docs, Scratch(spark)).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = fresh(docs, "_secrets")
    found = secrets.scan(docs, Scratch(spark), out=own)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col(own)["merged"]))
    return clean.withColumn("n_chars", F.when(F.size(F.col(own)["spans"]) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, Scratch(spark)).withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Near-duplicate components and seeded block selection are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages on the documents of ``sf_dir``.

    A stage's own tables, and the result before it, go once its result is written. With ``name`` the results lie in a folder
    of that name: a run that died is taken up after its last finished stage (of the same documents).
    """
    scratch = Scratch(spark, name)
    docs, before, steps = table(spark, sf_dir, "documents"), None, [f"{i}_{stage}" for i, (stage, _) in enumerate(STAGES)]
    done = max((i for i, step in enumerate(steps) if scratch.has(step)), default=-1)
    if done >= 0:
        docs, before = scratch.load(steps[done]), steps[done]
    for step, (_, stage) in list(zip(steps, STAGES, strict=True))[done + 1 :]:
        with scratch.owning():
            docs = scratch.save(stage(spark, docs, sf_dir), step)
        scratch.close_owned()
        if before:
            scratch.drop(before)
        before = step
    return docs
