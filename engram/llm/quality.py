"""Quality rules: a threshold table compiled into one Spark projection.

Every rule bounds one metric of a text from below, above or both. ``compile_rules`` turns the table into a column of
the names of failed rules; all metrics come from built-in higher-order functions, so no user function is evaluated
and no row leaves its partition.

Edge cases: a null text counts as empty; an empty text has no words, all counts 0 and fails the base test; repeated
rows and clashing extra columns pass through unchanged, as metrics are built from the text column alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import BLANKS, let, words

#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Punctuation removed before a word is compared with the stop words.
EDGE_MARKS = ".,;:!?\"'()[]{}" + SYMBOLS
#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of and to a in is it that was for on with as by this are be from not at or an "
    "le la les un une de des du et est en que qui pour dans avec sur pas au "
    "der die das und ist ein eine zu den von mit dem im auf sich nicht des für als "
    "el los las y que se del por con una su al lo es no"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``metric`` is below ``low`` or above ``high``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table of the registered query.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("capitals", "capital_ratio", None, 0.6),
)


def repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows found at least twice in the array ``w``, in n log n steps.

    Windows are sorted by a 64-bit hash; neighbours of one hash are compared by their words, so no windows are taken for equal
    that are not.
    """
    n = F.size(w)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))
    grams = F.coalesce(grams, F.expr("cast(array() as array<struct<h:bigint,p:int>>)"))

    def equal(x: Column, y: Column) -> Column:
        words_equal = lambda i: F.get(w, x["p"] + i) == F.get(w, y["p"] + i)
        return (x["h"] == y["h"]) & words_equal(0) & words_equal(1) & words_equal(2)

    twice = lambda s: F.filter(s, lambda x, i: F.coalesce(equal(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(s, i + 1)), F.lit(False)))
    at = F.sort_array(F.transform(let(F.sort_array(grams), twice), lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"))
    return F.aggregate(at, start, step, lambda acc: acc["n"])


def base_metrics(text: Column) -> Column:
    """One struct with the counts of the text; everything a rule can use is derived from it."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = F.translate(F.lower(text), BLANKS + EDGE_MARKS, " " * len(BLANKS))  # blanks become spaces, marks go
    return F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"), F.length(F.array_join(w, "")).cast("long").alias("chars"))).alias("w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        F.size(F.filter(F.split(plain, " "), lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """The threshold table as one expression: the array of names of the rules that fail."""
    n = m["w"]["n"]
    metrics = {
        "n_words": n.cast("double"),
        "mean_word_chars": ratio(m["w"]["chars"], n),
        "symbols_per_word": ratio(m["n_symbols"], n),
        "stop_word_ratio": ratio(m["n_stop"], n),
        "dup_line_ratio": ratio(m["lines"]["dup"], m["lines"]["n"]),
        "repeat_ratio": ratio(m["w"]["r"], n),
        "capital_ratio": ratio(m["n_capitals"], m["w"]["chars"]),
    }
    broken = []
    for r in rules:
        value = metrics[r.metric]
        bad = (F.lit(False) if r.low is None else value < r.low) | (F.lit(False) if r.high is None else value > r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.expr("cast(array() as array<string>)")


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Counts and verdict of one text as a struct; the metrics are a lambda variable, so they are computed once."""

    def judge(m: Column) -> Column:
        n, r = m["w"]["n"], m["w"]["r"]
        base_failed = (n < 50) | (100 * r > 50 * n)
        counts = [n.alias("n_words"), m["w"]["chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["dup"].alias("n_dup_lines"), r.alias("n_repeat_words")]
        return let(compile_rules(rules, m), lambda failed: F.struct(*counts, base_failed.alias("base_failed"), failed.alias("failed_rules"), (~base_failed & (F.size(failed) == 0)).alias("kept")))

    return let(base_metrics(text), judge)


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    return docs.withColumn(out, verdict(F.col(text), rules))
