"""Counters, histograms and summaries of a plan's rows, and timers of operations."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds the measures (aggregates) when an action has run over them: no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, *[m.alias(k) for k, m in measures.items()]), seen


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """by, le (null: no bound), n: how many values are at most each bound, as in cumulative histograms; in one aggregation."""
    counts = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count(F.when(F.col(value) <= b, 1)).alias("n")) for b in sorted(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.count(value).alias("n")))
    return df.groupBy(*by).agg(counts.alias("all")).select(*by, F.explode("all").alias("b")).select(*by, "b.le", "b.n")


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, total, least and greatest of a value."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))


class Operations:
    """Counts and seconds of named operations on the driver."""

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.seconds: dict[str, float] = {}
        self.failures: dict[str, int] = {}

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        except BaseException:
            self.failures[name] = self.failures.get(name, 0) + 1
            raise
        finally:
            self.counts[name] = self.counts.get(name, 0) + 1
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
