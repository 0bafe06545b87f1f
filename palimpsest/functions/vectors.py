"""Similarity of array columns, in double arithmetic, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2", "l1")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def similarity(a: Column, b: Column, metric: str | None = None) -> Column:
    """The score of a metric; none is cosine."""
    return {"cosine": cosine, "dot": dot, "l2": l2, "l1": l1}[metric or "cosine"](a, b)


def higher_is_better(metric: str | None) -> bool:
    if (metric or "cosine") not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return (metric or "cosine") in ("cosine", "dot")


def best_first(metric: str | None, score: str = "score") -> Column:
    return F.desc(score) if higher_is_better(metric) else F.asc(score)


def passes(metric: str | None, score: Column, threshold: float | None) -> Column:
    """Whether a score reaches the threshold: at least it where higher is better, else at most."""
    if threshold is None:
        return F.lit(True)
    return score >= threshold if higher_is_better(metric) else score <= threshold


def score_of_distance(distance: Column, metric: str | None = None, squared: bool = False) -> Column:
    """The score that an index's distance stands for: 1 - d for cosine and dot; l2 of squared distances is their root."""
    if (metric or "cosine") in ("cosine", "dot"):
        return 1 - distance
    return F.sqrt(distance) if squared and metric == "l2" else distance


def distance_of_score(score: Column, metric: str | None = None, squared: bool = False) -> Column:
    """The greatest distance at which a score's threshold holds: the way back of score_of_distance."""
    if (metric or "cosine") in ("cosine", "dot"):
        return 1 - score
    return score * score if squared and metric == "l2" else score


def mean(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors, as with the chunks of a text."""
    total = F.aggregate(vectors, F.transform(vectors[0], lambda _: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))
