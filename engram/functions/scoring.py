"""Ranking features, normalizers, trust and link thresholds as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.schema import SOURCE_TRUST, Weights


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def decay(hours: Column, horizon: float, missing: float) -> Column:
    """exp(-h / H); the future counts 1."""
    return F.when(hours.isNull(), F.lit(missing)).when(hours <= 0, F.lit(1.0)).otherwise(F.exp(-hours / F.lit(horizon)))


def recency(hours: Column, horizon: float = 720.0) -> Column:
    return decay(hours, horizon, 1.0)


def temporal(hours: Column, horizon: float = 720.0) -> Column:
    return decay(hours, horizon, 0.0)


def centrality(degree: Column) -> Column:
    return F.log10(1 + F.least(F.coalesce(degree, F.lit(0)), F.lit(100)).cast("double"))


def path_decay(path_weight: Column) -> Column:
    return F.when(path_weight <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), path_weight))


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def components(similarity: Column, age_hours: Column, created_hours: Column | None, degree: Column, path_weight: Column, w: Weights) -> Column:
    """The features behind a score, as a struct."""
    t = F.lit(0.0) if created_hours is None else temporal(created_hours, w.temporal_hours)
    return F.struct(
        finite(similarity).alias("similarity"), recency(age_hours, w.recency_hours).alias("recency"), t.alias("temporal"),
        centrality(degree).alias("centrality"), path_decay(path_weight).alias("decay"), (1 - path_decay(path_weight)).alias("depth_penalty"),
    )


def composite(c: Column, w: Weights) -> Column:
    """Weighted features times the path decay; not a number counts 0."""
    return finite((w.vector * c["similarity"] + w.recency * c["recency"] + w.temporal * c["temporal"] + w.centrality * c["centrality"]) * c["decay"])


def linear(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.lit(0.0) if high <= low else clamp((x - low) / (high - low))


def log_scale(x: Column, high: float = 1.0) -> Column:
    return F.lit(0.0) if high <= 0 else F.when(x <= 0, F.lit(0.0)).otherwise(F.least(F.log1p(x) / F.log1p(F.lit(float(high))), F.lit(1.0)))


def sigmoid(x: Column, midpoint: float = 0.0, steepness: float = 0.0) -> Column:
    """A midpoint of 0 means 0.5, a steepness of 0 means 1."""
    return 1 / (1 + F.exp(-(steepness or 1.0) * (x - (midpoint or 0.5))))


def tanh_scale(x: Column, midpoint: float = 0.0, steepness: float = 0.0) -> Column:
    return (F.tanh((steepness or 1.0) * (x - midpoint)) + 1) / 2


def normalizer(name: str, low: float = 0.0, high: float = 1.0) -> Callable[[Column], Column]:
    """A normalizer by name; an unknown name is linear."""
    middle, slope = (low + high) / 2, 4.0 / (high - low) if high != low else 0.0
    return {"log": lambda x: log_scale(x, high), "sigmoid": lambda x: sigmoid(x, middle, slope), "tanh": lambda x: tanh_scale(x, middle, slope)}.get(name, lambda x: linear(x, low, high))


def trust(confidence: Column, source: Column, age_hours: Column, horizon: float = 720.0) -> Column:
    """clamp(confidence * source weight * exp(-h / H)); a source without weight counts 0.5."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in SOURCE_TRUST.items() for v in kv]), source), F.lit(0.5))
    return clamp(confidence * weight * decay(age_hours, horizon, 1.0))


def adaptive_threshold(base: Column, average_degree: Column) -> Column:
    """base * (1 + 0.2 * (1 - exp(-d / 10))), at most 1; base without neighbours."""
    return F.when(F.coalesce(average_degree, F.lit(0.0)) <= 0, base).otherwise(F.least(base * (1 + 0.2 * (1 - F.exp(-average_degree / 10))), F.lit(1.0)))


def round_to(x: Column, digits: int = 4) -> Column:
    """Half away from zero at that many digits; not-a-number and infinities count 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.round(x, digits))
