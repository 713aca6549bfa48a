"""Joins by range: points in intervals, as an equi-join on buckets of the line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, on: list[str] | None = None) -> DataFrame:
    """``points`` with every interval (start inclusive, end exclusive) that holds ``at``, and equal in the columns ``on``.

    The line is cut into buckets of ``width``; an interval is copied to each bucket it touches, a point lies in one, so no
    pair is found twice. Choose a width near the length of most intervals.
    """
    on = on or []
    bucket = lambda c: F.floor(F.col(c) / width)
    last = F.floor((F.col(end) - 1) / width)
    left = points.withColumn("_bucket", bucket(at))
    right = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), last)))
    return left.join(right, [*on, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")
