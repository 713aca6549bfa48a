"""The library's functions callable from SQL: scalar and table functions as SQL expressions, an aggregate over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, parameters, result, body: expressions that the optimizer sees through.
SCALAR = (
    ("dot_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("cosine_similarity", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "if(size(a) <> size(b) or dot_product(a, a) = 0 or dot_product(b, b) = 0, 0D, dot_product(a, b) / (sqrt(dot_product(a, a)) * sqrt(dot_product(b, b))))"),
    ("time_decay", "hours DOUBLE, horizon DOUBLE", "DOUBLE", "case when hours is null then 1D when hours <= 0 then 1D else exp(-hours / horizon) end"),
    ("centrality_of", "degree BIGINT", "DOUBLE", "log10(1 + least(coalesce(degree, 0), 100))"),
    ("source_weight", "kind STRING", "DOUBLE", "case kind when 'user' then 1D when 'observation' then 0.9D when 'extraction' then 0.7D when 'inference' then 0.5D when 'external' then 0.3D else 0.5D end"),
    ("trust_of", "confidence DOUBLE, kind STRING, hours DOUBLE", "DOUBLE", "greatest(least(confidence * source_weight(kind) * time_decay(hours, 720D), 1D), 0D)"),
    ("token_estimate", "content STRING", "BIGINT", r"cast(aggregate(filter(split(content, '\\s+'), w -> w <> ''), 0D, (s, w) -> s + ceil(octet_length(w) / 4)) as bigint)"),
)


def register(spark: SparkSession, entities: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    """Registers all functions in the session; with ``entities`` and ``edges`` also the views of these names and the table
    function ``neighbors_of(id)``."""
    for name, parameters, result, body in SCALAR:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

    @F.pandas_udf("double")
    def weighted_mean(value: pd.Series, weight: pd.Series) -> float:
        """The mean of one group's values by weight; null without weight."""
        known = value.notna() & weight.notna()
        total = float(weight[known].sum())
        return float((value[known] * weight[known]).sum() / total) if total else None

    spark.udf.register("weighted_mean", weighted_mean)
    if entities is not None and edges is not None:
        entities.createOrReplaceTempView("entities")
        edges.createOrReplaceTempView("edges")
        spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION neighbors_of(start BIGINT) RETURNS TABLE(id BIGINT, relation STRING, content STRING) RETURN
            SELECT e.id, x.relation_type, e.content FROM (SELECT target_id AS id, relation_type FROM edges WHERE source_id = neighbors_of.start UNION ALL SELECT source_id, relation_type FROM edges WHERE target_id = neighbors_of.start) x JOIN entities e ON e.id = x.id WHERE NOT coalesce(e.archived, false)""")
