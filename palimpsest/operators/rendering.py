"""Contexts and search results as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as X

from .context import continues, islands
from .segments import ORDER


def _ordered(items: list[str]) -> Column:
    """The rows' `piece` values of a group in the order of the given columns."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*items, "piece"))), lambda x: x["piece"])


def contexts(segments: DataFrame, by: list[str], date: str | None = "full", time: str | None = "short") -> DataFrame:
    """by and text of each context: a line per block, its continuations joined, `[time] producer: "text"`; blocks without text as [kind]."""
    marked = segments.withColumn("__new", F.when(continues("event_uid", "index", by, ORDER), 0).otherwise(1))
    numbered = marked.withColumn("__line", F.sum("__new").over(W.partitionBy(*by).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)))
    lines = numbered.groupBy(*by, "__line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", F.coalesce("text", F.lit("")).alias("piece")))), lambda x: x["piece"]), "").alias("said"),
        F.min_by(F.struct("ts", "producer", "kind", F.col("text").isNull().alias("silent")), "offset").alias("first"),
    )
    header = F.concat(F.concat(F.lit("["), X.formatted(F.col("first.ts"), date, time), F.lit("] ")) if date or time else F.lit(""), F.when(F.col("first.producer").isNotNull(), F.concat("first.producer", F.lit(": "))).otherwise(""))
    silent = F.when(F.col("first.silent"), F.concat(F.lit("["), "first.kind", F.lit("]\n"))).otherwise("")
    line = F.concat(header, silent, X.json_quoted(F.col("said")))
    return lines.select(*by, "__line", line.alias("piece")).groupBy(*by).agg(F.array_join(_ordered(["__line"]), "\n").alias("text"))


def joined_contexts(segments: DataFrame, by: list[str], low: str, high: str, place: str, partition: list[str], date: str | None = "full", time: str | None = "short") -> DataFrame:
    """by and text: contexts that share segments are one; each once, in the order of time, a blank line between.

    segments: rows of contexts, with the range (low, high) of places that their context covers.
    """
    spans = segments.select(*by, *partition, low, high).distinct()
    numbered = islands(spans, [*by, *partition], low, high)
    once = segments.join(numbered, [*by, *partition, low, high]).dropDuplicates([*by, *partition, place])
    keys = [*by, *partition, "island"]
    firsts = once.groupBy(*keys).agg(F.min(F.struct(*ORDER)).alias("first"))
    texts = contexts(once, keys, date, time).join(firsts, keys)
    return texts.select(*by, "first", F.col("text").alias("piece")).groupBy(*by).agg(F.array_join(_ordered(["first"]), "\n\n").alias("text"))


def episode_lines(episodes: DataFrame, by: list[str], order: list[str], at: str = "created_at", who: str = "producer_id", text: str = "content") -> DataFrame:
    """by and text of episodes in their order, a line each."""
    whole = F.when(F.col(at).isNull(), F.concat(who, F.lit(": "), X.json_quoted(F.col(text)))).otherwise(X.line(F.col(at), F.col(who), F.col(text)))
    return episodes.select(*by, *order, F.concat(whole, F.lit("\n")).alias("piece")).groupBy(*by).agg(F.array_join(_ordered(order), "").alias("text"))


def query_with_context(query: Column, summary: Column, episodes: Column) -> Column:
    """A query wrapped with the summary and the episodes; blank ones are left out."""
    part = lambda name, body: F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(f"<{name}>\n"), body, F.lit(f"</{name}>\n"))).otherwise("")
    told = F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", F.concat(F.trim(summary), F.lit("\n")))
    return F.concat(part("Summary", told), part("Episodes", episodes), F.lit("<Query>\n"), query, F.lit("\n</Query>"))


def search_result(episodes: Column, profile: Column) -> Column:
    """[Episodic Memory] and [Semantic Memory] sections of those that are there."""
    part = lambda name, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"[{name} Memory]\n"), body))
    return F.concat_ws("\n", part("Episodic", episodes), part("Semantic", profile))
