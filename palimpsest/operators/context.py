"""Neighbours of seeds, keyset scans, budgeted unions and overlapping contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_expansion(expand: int, most: int | None = None) -> tuple[int, int]:
    """(backward, forward) of an expansion: a third of it goes back."""
    if most is not None:
        expand = max(0, min(expand, most - 1))
    return expand // 3, expand - expand // 3


def neighbours(rows: DataFrame, seeds: DataFrame, partition: list[str], order: list[str], key: str, backward: int, forward: int, where: Column | None = None) -> DataFrame:
    """For each seed (column seed) the rows up to `backward` before and `forward` after it, itself included.

    The filter holds for seeds and neighbours and comes before counting. The
    rows are numbered once per partition; seeds then join their numbers, so the
    cost does not depend on the number of seeds times the partition's size.
    distance is 0 for the seed, negative before it.
    """
    given = rows if where is None else rows.where(where)
    numbered = given.withColumn("__n", F.row_number().over(W.partitionBy(*partition).orderBy(*order)))
    found = numbered.join(seeds.select("seed").distinct(), F.col(key) == F.col("seed")).select("seed", *partition, F.col("__n").alias("__at"))
    reach = found.withColumn("distance", F.explode(F.sequence(F.lit(-backward), F.lit(forward)))).withColumn("__n", F.col("__at") + F.col("distance")).drop("__at")
    return reach.join(numbered, [*partition, "__n"]).drop("__n")


def keyset(rows: DataFrame, by: list[str], start: list[Column | None], ascending: list[bool], include_equal: bool = False, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows beyond a start in the order of several columns, each up or down. A start of None asks for non-null values only."""
    past, equal, present = F.lit(False), F.lit(True), F.lit(True)
    for name, value, up in zip(by, start, ascending, strict=True):
        if value is None:
            present = present & F.col(name).isNotNull()
            continue
        past = past | (equal & ((F.col(name) > value) if up else (F.col(name) < value)))
        equal = equal & (F.col(name) == value)
    if include_equal or all(v is None for v in start):
        past = past | equal
    given = rows if where is None else rows.where(where)
    found = given.where(past & present).orderBy(*[F.asc(n) if up else F.desc(n) for n, up in zip(by, ascending)])
    return found if limit is None else found.limit(limit)


def proximity(distance: Column) -> Column:
    """Order of a context's rows when it is cut: the nearest first, forward before backward."""
    return F.when(distance >= 0, (distance - 0.5) / 2).otherwise(-distance)


def budget_union(contexts: DataFrame, limit: int, by: list[str], key: str, context_rank: str = "context_rank", distance: str = "distance") -> DataFrame:
    """The first `limit` distinct rows of ranked contexts: whole contexts while they fit, then the nearest to the seed.

    A context that fits is taken whole whatever its inner order, so one order
    (context rank, proximity) does for all. Each row keeps its first context.
    """
    order = [F.col(context_rank), proximity(F.col(distance))]
    once = contexts.withColumn("__first", F.row_number().over(W.partitionBy(*by, key).orderBy(*order))).where("__first = 1").drop("__first")
    return once.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order, key))).where(F.col("__n") <= limit).drop("__n")


def islands(rows: DataFrame, partition: list[str], start: str, end: str) -> DataFrame:
    """Number (from 1) of the group of intervals [start, end] that overlap or touch, directly or through others."""
    w = W.partitionBy(*partition).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col(start) > reached), 1).otherwise(0)
    return rows.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def continues(event: str, index: str, partition: list[str], order: list[str]) -> Column:
    """Whether a row goes on with the previous row's event and block."""
    w = W.partitionBy(*partition).orderBy(*order)
    return F.coalesce((F.lag(event).over(w) == F.col(event)) & (F.lag(index).over(w) == F.col(index)), F.lit(False))
