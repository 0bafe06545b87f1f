"""Short-term memory, and the search pipelines over long-term memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import context as C
from . import search as S


def short_term(messages: DataFrame, session: str, order: list[str], content: str = "content", most_chars: int = 0, limit: int = 0, summary_chars: Column | None = None, where: Column | None = None) -> DataFrame:
    """The newest messages of each session that fit, newest first, until the first that would not.

    Filtered messages are skipped, they end nothing. 0 is no bound. The count of
    characters starts at the summary's length. position is 1 for the newest.
    """
    given = messages if where is None else messages.where(where)
    newest = W.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    upto = newest.rowsBetween(W.unboundedPreceding, 0)
    start = F.lit(0) if summary_chars is None else summary_chars
    found = given.withColumns({"position": F.row_number().over(newest), "__chars": F.sum(F.length(content)).over(upto) + start})
    # sums only grow, so what fits is a prefix
    if most_chars:
        found = found.where(F.col("__chars") <= most_chars)
    if limit:
        found = found.where(F.col("position") <= limit)
    return found.drop("__chars")


def evicted(messages: DataFrame, session: str, order: list[str], capacity: int, content: str = "content", summarised: str = "summarised") -> DataFrame:
    """Messages that leave short-term memory: the oldest, already summarised ones, until the rest fits."""
    newest = W.partitionBy(session).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    oldest = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    kept = F.sum(F.length(content)).over(newest)
    all_before = F.min(F.col(summarised).cast("int")).over(oldest) == 1
    return messages.withColumns({"__kept": kept, "__done": all_before}).where((F.col("__kept") > capacity) & F.col("__done")).drop("__kept", "__done")


def merge_terms(short: DataFrame, long: DataFrame, key: str = "uid", rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Long-term hits, once each (for each query, columns `by`) by their best rank, without what short-term memory holds."""
    keys = [*(by or []), key]
    once = long.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(rank))).where("__n = 1").drop("__n")
    return once.join(short.select(*keys), keys, "left_anti")


def event_search(queries: DataFrame, derivatives: DataFrame, segments: DataFrame, partition: list[str], limit: int = 20, expand: int = 0, metric: str | None = None, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """Vector search over derivatives, best score per segment, neighbours of each segment in its order; ranked by seed.

    derivatives(uid, segment_uid, embedding), segments(uid, *partition, ts, event_uid, index, offset). The filter holds
    for seeds and neighbours; longterm.rescored ranks the contexts again by a reranker. digits: see search.best_per_seed.
    """
    hits = S.knn(queries, derivatives, limit, metric, tie="uid")
    seeds = S.best_per_seed(hits, "segment_uid", metric, digits)
    backward, forward = C.split_expansion(expand)
    found = C.neighbours(segments, seeds.select(F.col("segment_uid").alias("seed")), partition, ["ts", "event_uid", "index", "offset"], "uid", backward, forward, where)
    return seeds.withColumnRenamed("segment_uid", "seed").withColumnRenamed("seed_rank", "context_rank").join(found, "seed")


def declarative_contexts(queries: DataFrame, derivatives: DataFrame, sources: DataFrame, episodes: DataFrame, partition: list[str], most: int = 20, expand: int = 0, metric: str | None = None, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """Vector search (5 derivatives per wanted episode, 200 at most), source episodes by first hit, and the context of each. digits: see search.best_per_seed."""
    hits = S.knn(queries, derivatives, min(5 * most, 200), metric, tie="uid")
    seeds = S.best_per_seed(hits.join(sources, "uid"), "episode_uid", metric, digits).withColumnRenamed("episode_uid", "seed").withColumnRenamed("seed_rank", "context_rank")
    backward, forward = C.split_expansion(expand, most)
    return seeds.join(C.neighbours(episodes, seeds, partition, ["ts", "uid"], "uid", backward, forward, where), "seed")


def declarative_search(queries: DataFrame, derivatives: DataFrame, sources: DataFrame, episodes: DataFrame, partition: list[str], most: int = 20, expand: int = 0, metric: str | None = None, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """declarative_contexts as one budgeted union."""
    return C.budget_union(declarative_contexts(queries, derivatives, sources, episodes, partition, most, expand, metric, where, digits), most, ["query_id"], "uid")


def summarise(messages: DataFrame, session: str, order: list[str], summaries: DataFrame, summary, capacity: int, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(messages left, summaries) after the sessions that are over their capacity hand what is over to `summary(old summary, texts)`.

    The newest messages that fit stay; the older ones go into the session's summary, in order.
    """
    newest = W.partitionBy(session).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    sized = messages.withColumn("__chars", F.sum(F.length(content)).over(newest))
    over = sized.where(F.col("__chars") > capacity)
    texts = over.groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, content))), lambda x: x[content]).alias("texts"))
    run = F.udf(lambda old, new: summary(old or "", list(new)), "string")
    fresh = texts.join(summaries, session, "left").select(session, run("summary", "texts").alias("summary"))
    return sized.where(F.col("__chars") <= capacity).drop("__chars"), upsert_summary(summaries, fresh, session)


def upsert_summary(summaries: DataFrame, fresh: DataFrame, session: str = "session_key") -> DataFrame:
    """Summaries (session, summary) with the fresh ones in place of older ones."""
    return summaries.join(fresh, session, "left_anti").unionByName(fresh)


def content_length(messages: DataFrame, session: str, content: str = "content") -> DataFrame:
    """Characters of each session's messages."""
    return messages.groupBy(session).agg(F.sum(F.length(content)).alias("chars"))


def segment_order(df: DataFrame, by: list[str]) -> DataFrame:
    """position of each row by time, event, block and offset."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy("ts", "event_uid", "index", "offset")))


def final_rerank(hits: DataFrame, limit: int, by: list[str], score: str | None = "score", time: list[str] | None = None) -> DataFrame:
    """limit <= 0: all by time; without a score the first by time; else the best by score, then by time. position from 1."""
    order = time or ["ts", "uid"]
    found = hits
    if limit > 0:
        first = W.partitionBy(*by).orderBy(*([F.desc(score), *order] if score else order))
        found = hits.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= limit).drop("__n")
    return found.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
