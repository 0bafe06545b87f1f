"""The segment store, segmenters and derivers.

segments(partition_key, uid, event_uid, index, offset, ts, producer, kind, text, properties) and
links(partition_key, uid, segment_uid): what was derived from a segment. Blocks without text have a null text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X

from .tables import insert_missing, without_ids

ORDER = ["ts", "event_uid", "index", "offset"]


def append(segments: DataFrame, links: DataFrame, new_segments: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the new rows; segments and links that are there already stay as they are."""
    return insert_missing(segments, new_segments, ["partition_key", "uid"]), insert_missing(links, new_links, ["partition_key", "uid"])


def delete(segments: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the segments of the ids (first column) and what was derived from them."""
    return without_ids(segments, ids, "uid"), without_ids(links, ids, "segment_uid")


def delete_partition(segments: DataFrame, links: DataFrame, partition_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a partition."""
    other = F.col("partition_key") != partition_key
    return segments.where(other), links.where(other)


def of_events(segments: DataFrame, events: DataFrame) -> DataFrame:
    """event_uid and the sorted uids of its segments, for the given events (first column) that have any."""
    wanted = events.toDF("event_uid").distinct()
    return segments.join(wanted, "event_uid", "left_semi").groupBy("event_uid").agg(F.array_sort(F.collect_list("uid")).alias("segment_uids"))


def derivatives_of(links: DataFrame, segments: DataFrame) -> DataFrame:
    """segment_uid and the sorted uids derived from it, for the given segments (first column) that have any."""
    wanted = segments.toDF("segment_uid").distinct()
    return links.join(wanted, "segment_uid", "left_semi").groupBy("segment_uid").agg(F.array_sort(F.collect_list("uid")).alias("derivative_uids"))


def passed_through(events: DataFrame, blocks: str = "blocks") -> DataFrame:
    """One segment for each block (struct of kind, text) of an event: index is the block's place, offset 0."""
    kept = [c for c in events.columns if c != blocks]
    rows = events.select(*kept, F.posexplode(blocks).alias("index", "block"))
    return rows.select(*kept, "index", F.lit(0).alias("offset"), F.col("block.kind").alias("kind"), F.col("block.text").alias("text"))


def split(events: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Segments of text blocks cut by the recursive splitter: index is the block's place, offset the piece's."""
    whole = passed_through(events, blocks).drop("offset")
    kept = [c for c in whole.columns if c != "text"]
    return whole.where(F.col("text").isNotNull()).select(*kept, F.posexplode(X.segments("text")).alias("offset", "text"))


def _anchor(who: Column, at: Column, text: Column, date: str | None, time: str | None) -> Column:
    """[time] producer: "text"; without a producer or without styles the part is left out."""
    body = F.when(who.isNull(), X.json_quoted(text)).otherwise(F.concat(who, F.lit(": "), X.json_quoted(text)))
    return F.concat(F.lit("["), X.formatted(at, date, time), F.lit("] "), body) if date or time else body


def derive(segments: DataFrame, per_sentence: bool = False, date: str | None = "full", time: str | None = None) -> DataFrame:
    """segment_uid, n, text: the text that is embedded for a segment, whole or one row per sentence."""
    given = segments.where(F.col("text").isNotNull())
    pieces = X.sentences(F.col("text")) if per_sentence else F.array("text")
    rows = given.select(F.col("uid").alias("segment_uid"), "producer", "ts", F.posexplode(pieces).alias("n", "piece"))
    return rows.select("segment_uid", "n", _anchor(F.col("producer"), F.col("ts"), F.col("piece"), date, time).alias("text"))


def derive_declarative(episodes: DataFrame, per_sentence: bool = False) -> DataFrame:
    """uid, n, text of episodes (uid, source, content, content_type): messages as "source: content", texts as they are; other types give none."""
    pieces = F.when(F.col("content_type") == "text", F.array("content")).when(F.col("content_type") == "message", X.sentences(F.col("content")) if per_sentence else F.array("content"))
    rows = episodes.select("uid", "source", "content_type", F.posexplode(pieces).alias("n", "piece"))
    return rows.select("uid", "n", F.when(F.col("content_type") == "message", F.concat("source", F.lit(": "), F.col("piece"))).otherwise(F.col("piece")).alias("text"))
