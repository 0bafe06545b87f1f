"""Clusters of events: adjacent signals, splits, centroids, and online assignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import vectors as V


def adjacent(events: DataFrame, cluster: list[str], order: list[str], vector: str = "embedding", time: str = "ts") -> DataFrame:
    """Each event with similarity and gap (seconds) to the next one of its cluster; null for the last."""
    w = W.partitionBy(*cluster).orderBy(*order)
    following = F.lead(vector).over(w)
    gap = F.abs(F.unix_micros(F.lead(time).over(w)) - F.unix_micros(time)) / 1_000_000
    return events.withColumns({"similarity": F.when(following.isNotNull(), V.cosine(F.col(vector), following)), "gap": gap})


def signals(adjacents: DataFrame, cluster: list[str]) -> DataFrame:
    """Size, and minimum, maximum, mean and population deviation of the adjacent similarities."""
    return adjacents.groupBy(*cluster).agg(
        F.count("*").alias("n"), F.min("similarity").alias("low"), F.max("similarity").alias("high"), F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("deviation")
    )


def split_segments(adjacents: DataFrame, cluster: list[str], order: list[str], score: str = "similarity", at_most: float = 0.5, max_gap: float | None = None, z: float | None = 2.0, first: int = 20) -> DataFrame:
    """segment (from 0) of each of the first events of a cluster: cut after an event whose normalised score is low, whose gap is long, or whose score is far below the mean."""
    per = W.partitionBy(*cluster)
    ordered = per.orderBy(*order)
    given = adjacents.withColumn("__n", F.row_number().over(ordered)).where(F.col("__n") <= first)
    low, high = F.min(score).over(per), F.max(score).over(per)
    given = given.withColumn("normal", F.when(F.col(score).isNull(), None).when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))
    cut = F.coalesce(F.col("normal") <= at_most, F.lit(False))
    if max_gap is not None:
        cut = cut | F.coalesce(F.col("gap") > max_gap, F.lit(False))
    if z is not None:
        deviation = F.stddev_pop(score).over(per)
        cut = cut | F.coalesce((deviation > 0) & ((F.avg(score).over(per) - F.col(score)) / deviation >= z), F.lit(False))
    marked = given.withColumn("__cut", cut.cast("int"))
    last = F.max("__n").over(per)
    marked = marked.withColumn("__cut", F.when(F.col("__n") == last, 0).otherwise(F.col("__cut")))
    return marked.withColumn("segment", F.coalesce(F.sum("__cut").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n", "__cut")


def centroids(events: DataFrame, by: list[str], vector: str = "embedding", time: str | None = "ts") -> DataFrame:
    """Mean vector, count and last time of each group; positions are averaged apart, so no group is collected."""
    mean = events.select(*by, F.posexplode(vector).alias("at", "x")).groupBy(*by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = mean.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centroid"))
    totals = events.groupBy(*by).agg(F.count("*").alias("n"), *([F.max(time).alias("last")] if time else []))
    return totals.join(lists, by)


@dataclass
class Clusters:
    """Clusters of one set: centroid, count and last time each."""

    threshold: float = 0.3
    max_gap: float | None = None
    centroids: list[np.ndarray] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    last: list[float] = field(default_factory=list)
    assigned: dict = field(default_factory=dict)

    def assign(self, event, vector: list[float], at: float) -> int:
        """The cluster of an event: the most similar eligible one (the first of equals) if similar enough, else a new one. Idempotent."""
        if event in self.assigned:
            return self.assigned[event]
        v = np.asarray(vector, dtype=np.float64)
        best, best_score = -1, -np.inf
        for k, c in enumerate(self.centroids):
            if self.max_gap is not None and abs(at - self.last[k]) > self.max_gap:
                continue
            if len(c) != len(v):
                raise ValueError("vectors of different dimensions")
            norms = np.linalg.norm(c) * np.linalg.norm(v)
            score = float(c @ v / norms) if norms else 0.0
            if score > best_score:
                best, best_score = k, score
        if best < 0 or best_score < self.threshold:
            self.centroids.append(v)
            self.counts.append(1)
            self.last.append(at)
            best = len(self.counts) - 1
        else:
            n = self.counts[best]
            self.centroids[best] = (self.centroids[best] * n + v) / (n + 1)
            self.counts[best] = n + 1
            self.last[best] = max(self.last[best], at)
        self.assigned[event] = best
        return best


def online(events: DataFrame, key: str, event: str, threshold: float = 0.3, max_gap: float | None = None, vector: str = "embedding", time: str = "ts") -> DataFrame:
    """key, event, cluster: events of each key assigned in the order (time, event).

    The fold is sequential by its meaning; a key's events are streamed in order
    through one task that keeps the clusters only.
    """
    kinds = f"{key} {events.schema[key].dataType.simpleString()}, {event} {events.schema[event].dataType.simpleString()}, cluster int"
    given = events.select(key, event, F.col(vector).alias("__v"), (F.unix_micros(time) / 1_000_000).alias("__t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, names, found, _ in _folded(batches, threshold, max_gap):
            if found:
                yield pd.DataFrame({key: keys, event: names, "cluster": np.array(found, dtype=np.int32)})

    return given.repartition(key).sortWithinPartitions(key, "__t", event).mapInPandas(run, kinds)


def _folded(batches: Iterator[pd.DataFrame], threshold: float, max_gap: float | None) -> Iterator[tuple]:
    """Per batch its keys, events and clusters, and the states (key, clusters) that ended in it; the last state comes alone."""
    current, state = None, Clusters(threshold, max_gap)
    for pdf in batches:
        out, ended = [], []
        for k, e, v, t in pdf.itertuples(index=False):
            if k != current:
                ended += [(current, state)] if state.counts else []
                current, state = k, Clusters(threshold, max_gap)
            out.append(state.assign(e, v, t))
        yield pdf.iloc[:, 0], pdf.iloc[:, 1], out, ended
    yield pd.Series(dtype=object), pd.Series(dtype=object), [], [(current, state)] if state.counts else []


def online_state(events: DataFrame, key: str, event: str, threshold: float = 0.3, max_gap: float | None = None, vector: str = "embedding", time: str = "ts") -> DataFrame:
    """key, centroids, counts, last (epoch seconds) after online(): what later events go on from."""
    kinds = f"{key} {events.schema[key].dataType.simpleString()}, centroids array<array<double>>, counts array<long>, last array<double>"
    given = events.select(key, event, F.col(vector).alias("__v"), (F.unix_micros(time) / 1_000_000).alias("__t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for *_, ended in _folded(batches, threshold, max_gap):
            if ended:
                yield pd.DataFrame({key: [k for k, _ in ended], "centroids": [[c.tolist() for c in s.centroids] for _, s in ended], "counts": [s.counts for _, s in ended], "last": [s.last for _, s in ended]})

    return given.repartition(key).sortWithinPartitions(key, "__t", event).mapInPandas(run, kinds)
