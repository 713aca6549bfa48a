"""What the training-data operators share: tables and word splitting, with the core's scratch storage, ranks and components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.components import connected_components  # noqa: F401
from engram.operators.ranks import global_rank  # noqa: F401
from engram.sources.scratch import Scratch  # noqa: F401

#: Fixed value: the white space that separates words, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once: a lambda variable is never inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A prefix that no column of ``df`` starts with, in either case, for the operators' own columns."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem = "_" + stem
    return stem
