"""Scores of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_level(df: DataFrame, first: str, second: str, score: str) -> DataFrame:
    """Mean (4 digits) and count over all rows and by each of two columns, in one pass of grouping sets.

    level tells them apart where a value is null: 1 by the first, 2 by the second, 3 over all.
    """
    a, b = F.col(first), F.col(second)
    sets = df.groupingSets([[a], [b], []], a, b)
    return sets.agg(F.round(F.avg(score), 4).alias("mean"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def tool_report(df: DataFrame, tool: str, correct: Column, hits: Column, facts: Column, retrieved: Column) -> DataFrame:
    """Accuracy, recall and precision per tool."""
    found = df.groupBy(tool).agg(F.count("*").alias("n"), F.sum(correct.cast("int")).alias("right"), F.sum(hits).alias("hits"), F.sum(facts).alias("facts"), F.sum(retrieved).alias("retrieved"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return found.select(tool, "n", share("right", "n").alias("accuracy"), share("hits", "facts").alias("recall"), share("hits", "retrieved").alias("precision"))


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and interquartile range (linear interpolation)."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"))


def set_scores(reference: Column, found: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets; empty ones score 0."""
    a, b = F.array_distinct(reference), F.array_distinct(found)
    hits = F.size(F.array_intersect(a, b))
    precision, recall = F.when(F.size(b) > 0, hits / F.size(b)).otherwise(0.0), F.when(F.size(a) > 0, hits / F.size(a)).otherwise(0.0)
    return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def kendall(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Kendall's tau-b of two rankings (item, rank_a, rank_b; null: one after the list's last), normalised to 0..1, and times F1 of the items.

    Pairs that agree are counted without making pairs: in the order of a, then
    b, a pair disagrees where the later row has the smaller b. Such inversions are
    counted by halving the range of b (as a merge sort does): at each of its
    binary digits, rows with a 1 that precede rows with a 0 in the same half. So a
    list of n items costs n rows for each of log2(n) digits, whatever its length.
    """
    per = W.partitionBy(*by)
    last = lambda c: F.max(c).over(per) + 1
    filled = ranks.select(*by, F.coalesce("rank_a", last("rank_a")).alias("a"), F.coalesce("rank_b", last("rank_b")).alias("b"), F.col("rank_a").isNotNull().alias("in_a"), F.col("rank_b").isNotNull().alias("in_b"))
    placed = filled.withColumn("p", F.row_number().over(per.orderBy("a", "b"))).withColumn("d", F.dense_rank().over(per.orderBy("b")))
    totals = placed.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("in_a").cast("long")).alias("na"), F.sum(F.col("in_b").cast("long")).alias("nb"), F.sum((F.col("in_a") & F.col("in_b")).cast("long")).alias("both"))
    ties = lambda *c: placed.groupBy(*by, *c).agg((F.count("*") * (F.count("*") - 1) / 2).alias("t")).groupBy(*by).agg(F.sum("t").alias("t_" + "".join(c)))
    # digits beyond those of the longest list's length are 0 in every row and count nothing, so they are not made
    longest = filled.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    digits = F.sequence(F.lit(0), F.lit(max(1, longest.bit_length()) - 1))
    digit = placed.select(*by, "p", "d", F.explode(digits).alias("k")).withColumn("half", F.expr("shiftright(d, k + 1)")).withColumn("bit", F.expr("shiftright(d, k)").bitwiseAND(F.lit(1)))
    before = F.sum("bit").over(W.partitionBy(*by, "k", "half").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    inversions = digit.withColumn("above", F.coalesce(before, F.lit(0))).groupBy(*by).agg(F.sum(F.when(F.col("bit") == 0, F.col("above")).otherwise(0)).alias("wrong"))
    whole = totals.join(ties("a"), by).join(ties("b"), by).join(ties("a", "b"), by).join(inversions, by)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    score = pairs - F.col("t_a") - F.col("t_b") + F.col("t_ab") - 2 * F.col("wrong")
    base = F.sqrt((pairs - F.col("t_a")) * (pairs - F.col("t_b")))
    tau = F.when(base > 0, score / base).otherwise(0.0)
    f1 = F.when(F.col("na") + F.col("nb") > 0, 2 * F.col("both") / (F.col("na") + F.col("nb"))).otherwise(0.0)
    return whole.select(*by, tau.alias("tau"), ((tau + 1) / 2).alias("normalised"), ((tau + 1) / 2 * f1).alias("score"))


def rubric(df: DataFrame, by: list[str], score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("score"))
