"""Text functions: token estimates, lexical contradiction, merging and rendering helpers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType

#: Negation phrases, English then Russian.
NEGATIONS = (
    "not", "don't", "doesn't", "isn't", "aren't", "won't", "can't", "never", "no", "hate", "dislike",
    "разлюбил", "разлюбила", "разлюбили", "ненавижу", "ненавидит", "ненавидел", "ненавидела",
    "не ненавижу", "не ненавидит", "не ненавидел", "не ненавидела",
    "не люблю", "не любит", "не любил", "не любила", "не любили", "не хочу", "не хочет", "не хотел", "не хотела",
)
#: Suffixes cut from Cyrillic words, tested in this order.
SUFFIXES = (
    "ите", "ешь", "ете", "ем", "ет", "ют", "ут", "ят", "ат", "лась", "лось", "лись", "лся",
    "ил", "ел", "ал", "ёл", "ол", "ул", "юл", "ла", "ло", "ли", "ть", "ти",
    "ный", "ная", "ное", "ные", "ого", "ому", "ыми", "ая", "ое", "ые",
)
PARTICLE = " не"


def token_count(text: Column) -> Column:
    """Sum over words of ceil(bytes / 4)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s + F.ceil(F.octet_length(w) / 4).cast("bigint"))


def negation_flip(a: Column, b: Column) -> Column:
    """One text holds a negation phrase that the other does not. Built-in expressions only."""
    la, lb = F.lower(a), F.lower(b)
    flips = [F.contains(la, F.lit(n)) != F.contains(lb, F.lit(n)) for n in NEGATIONS]
    out = flips[0]
    for f in flips[1:]:
        out = out | f
    return out


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """A Cyrillic word without its first listed suffix, if three letters remain; other words as they are."""
    if not any("Ѐ" <= c <= "ӿ" for c in word):
        return word
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= 3), word)


def stemmed(text: str | None) -> str:
    return " ".join(stem(w) for w in unicodedata.normalize("NFC", text or "").lower().split())


@F.pandas_udf(ByteType())
def stem_marks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """1 if stemming changes the text, plus 2 if the negative particle stands in the stemmed one. Needs NFC, hence Arrow."""
    for a in texts:
        out = []
        for x in a.fillna(""):
            s = stemmed(x)
            out.append((s != x.lower()) + 2 * (PARTICLE in s))
        yield pd.Series(out, dtype="int8")


def lexical_marks(a: Column) -> Column:
    """What ``marks_contradict`` needs of one text: the phrases in it as bits, null without text, and its stem marks."""
    low = F.lower(a)
    phrases = [F.contains(low, F.lit(n)).cast("bigint") * F.lit(1 << i) for i, n in enumerate(NEGATIONS)]
    return F.struct(sum(phrases[1:], phrases[0]).alias("phrases"), stem_marks(a).alias("stems"))


def marks_contradict(a: Column, b: Column) -> Column:
    """A phrase in one text only, or the negative particle in one stemmed text only, where stemming changed one of them."""
    changed = a["stems"].bitwiseOR(b["stems"]).bitwiseAND(F.lit(1).cast("tinyint")) == 1
    particle = a["stems"].bitwiseXOR(b["stems"]).bitwiseAND(F.lit(2).cast("tinyint")) == 2
    return F.coalesce((a["phrases"] != b["phrases"]) | (changed & particle), F.lit(False))


def lexical_contradiction(a: Column, b: Column) -> Column:
    """Phrases first, then the stemmed particle. Where a text meets others in a join, its ``lexical_marks`` are enough."""
    return marks_contradict(lexical_marks(a), lexical_marks(b))


def embedding_contradiction(similarity: Column, a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Near in meaning, different in content."""
    return (similarity >= threshold) & (a != b)


def detection(detected: Column, confidence: Column | float, reason: str, inconclusive: Column | None = None) -> Column:
    """A detector's result as a struct: detected, inconclusive, confidence, reason."""
    confidence = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    return F.struct(F.coalesce(detected, F.lit(False)).alias("detected"), F.coalesce(inconclusive if inconclusive is not None else F.lit(False), F.lit(False)).alias("inconclusive"), confidence.alias("confidence"), F.lit(reason).alias("reason"))


def compose(first: Column, *others: Column) -> Column:
    """The composite detector: ``first`` must find or be unsure; then the last of the others that finds decides.

    Alone, ``first`` is the result. A result that nothing confirms is not detected, with confidence 0 and no reason.
    """
    none = F.struct(F.lit(False).alias("detected"), F.lit(False).alias("inconclusive"), F.lit(0.0).alias("confidence"), F.lit("").alias("reason"))
    out = none
    for o in others:
        out = F.when(o["detected"], o).otherwise(out)
    return F.when(first["detected"] | first["inconclusive"], out if others else first).otherwise(none)


def model_detection(answer: Column) -> Column:
    """A model's answer ``struct(contradiction boolean, confidence double)`` as a detection: no answer is no, a confidence
    that is not positive counts 0.5."""
    c = F.coalesce(answer["confidence"], F.lit(0.0))
    return detection(answer["contradiction"], F.when(c <= 0, F.lit(0.5)).otherwise(c), "model")


def resolve(confidence: Column, threshold: float = 0.7) -> Column:
    """``keep_both`` if the existing confidence (0 counts 1) reaches the threshold, else ``prefer_incoming``."""
    c = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(confidence)
    return F.when(c >= (threshold if threshold > 0 else 0.7), "keep_both").otherwise("prefer_incoming")


def merge_content(existing: Column, incoming: Column) -> Column:
    """``a; b`` unless a already holds b."""
    return F.when(F.contains(existing, incoming), existing).otherwise(F.concat_ws("; ", existing, incoming))


def strip_fence(text: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def parse_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


#: The fields of an extraction by a model.
EXTRACTION = "struct<entities:array<struct<id:string,category:string,content:string,relations:array<struct<target_id:string,relation_type:string>>>>>"


def parse_extraction(answer: Column) -> Column:
    """A model's JSON answer, with or without a code fence, as ``EXTRACTION``; null if it is no such JSON."""
    return F.from_json(strip_fence(answer), EXTRACTION, {"mode": "PERMISSIVE"})
