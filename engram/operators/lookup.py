"""Lookups, provenance, timelines and vocabulary checks over entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.schema import CATEGORIES


def by_id(df: DataFrame, key: object, column: str = "id") -> DataFrame:
    """Point lookup; the filter is pushed into the scan."""
    return df.where(F.col(column) == key)


def by_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Batch lookup as a semi-join, whatever the number of ids."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def provenance(entities: DataFrame, conversation: object = None, message: object = None, source: object = None, limit: int = 50) -> DataFrame:
    """Active entities of a conversation, a message or a source, newest first; at least one is needed, 200 rows at most."""
    tests = [F.col(c) == v for c, v in (("conversation_id", conversation), ("message_id", message), ("source", source)) if v is not None]
    if not tests:
        raise ValueError("a conversation, message or source is needed")
    any_of = tests[0]
    for t in tests[1:]:
        any_of = any_of | t
    return entities.where(any_of & ~F.coalesce("archived", F.lit(False))).orderBy(F.desc("created_at"), "id").limit(max(0, min(limit, 200)))


def entity_timeline(entities: DataFrame, age: Column, limit: int = 50) -> DataFrame:
    """Active entities with a creation time, newest (least age) first; a negative limit gives none."""
    return entities.where(~F.coalesce("archived", F.lit(False)) & age.isNotNull()).orderBy(age, "id").limit(max(0, limit))


def validate(entities: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) by declared category."""
    ok = F.coalesce(F.col("category").isin(*categories), F.lit(False))
    return entities.where(ok), entities.where(~ok)


def rebuild_selection(entities: DataFrame, category: str | None = None, max_age_hours: float | None = None, archived: bool = False) -> DataFrame:
    """Entities whose index entries are to be rebuilt."""
    df = entities if archived else entities.where(~F.coalesce("archived", F.lit(False)))
    if category:
        df = df.where(F.col("category") == category)
    return df if max_age_hours is None else df.where(F.col("age_hours") <= max_age_hours)


class Selection:
    """Conditions put together step by step: all of ``where`` and those of ``where_if`` whose arguments are set.

    Arguments are bound by ``?`` markers, never pasted into the text. The result is one plan: conditions reach the scan.
    """

    def __init__(self, df: DataFrame):
        self.df, self.conditions, self.arguments, self.sort, self.most = df, [], [], None, None

    def where(self, condition: str, *arguments: object) -> Selection:
        if condition.count("?") != len(arguments):
            raise ValueError(f"{condition!r} has {condition.count('?')} markers for {len(arguments)} arguments")
        self.conditions.append(f"({condition})")
        self.arguments += arguments
        return self

    def where_if(self, condition: str, *arguments: object) -> Selection:
        """Left out if an argument is null, empty text or zero."""
        unset = lambda a: a is None or (a in ("", 0) and not isinstance(a, bool))
        return self if any(unset(a) for a in arguments) else self.where(condition, *arguments)

    def order(self, order: str) -> Selection:
        self.sort = order
        return self

    def limit(self, n: int) -> Selection:
        """The first n rows; 0 and less is no limit."""
        self.most = n if n > 0 else None
        return self

    def text(self) -> str:
        where = f" WHERE {' AND '.join(self.conditions)}" if self.conditions else ""
        return "SELECT * FROM {rows}" + where + (f" ORDER BY {self.sort}" if self.sort else "") + (f" LIMIT {self.most}" if self.most else "")

    def build(self) -> DataFrame:
        return self.df.sparkSession.sql(self.text(), args=list(self.arguments) or None, rows=self.df)
