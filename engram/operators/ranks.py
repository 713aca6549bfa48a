"""Positions in a total order without a single-task sort."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.sources.scratch import Scratch


def global_rank(df: DataFrame, order: Sequence[Column], scratch: Scratch, name: str, rank: str = "rank") -> DataFrame:
    """``df`` with a dense 0-based position in the total order ``order``, computed without a single-task sort.

    Rows are range-partitioned and written once with their partition number, so the sampled ranges are fixed;
    only one count per partition reaches the driver.
    """
    cut = scratch.save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = sorted((r["_part"], r["n"]) for r in cut.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offset, offsets = 0, []
    for part, n in counts:
        offsets.append((part, offset))
        offset += n
    starts = cut.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"_part": p, "_offset": o} for p, o in offsets])), "array<struct<_part:int,_offset:bigint>>")))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn(rank, within).join(F.broadcast(starts), "_part").withColumn(rank, F.col(rank) - 1 + F.col("_offset")).drop("_part", "_offset")
