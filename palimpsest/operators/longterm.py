"""Search over long-term memory: thresholds, distinct episodes, hydration, agents' hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import vectors as V

from . import context as C
from . import memory as M
from . import search as S
from .rerank import by_model

#: Segments that are looked up for each wanted episode, as several can belong to one.
OVER_FETCH = 4


def rescored(contexts: DataFrame, queries: DataFrame, score: Callable[[str, str], float], order: list[str], text: str = "text") -> DataFrame:
    """query_id, seed, score, context_rank of contexts by a reranker on (query_text, the context's lines); ties keep their rank."""
    whole = contexts.groupBy("query_id", "seed", "context_rank").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "\n").alias("text"))
    given = whole.join(queries.select("query_id", F.col("query_text").alias("query")), "query_id").withColumnRenamed("seed", "pos")
    scores = given.join(by_model(given, score), ["query_id", "pos"]).withColumnRenamed("pos", "seed")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "context_rank")
    return scores.select("query_id", "seed", "score", F.row_number().over(best).alias("context_rank"))


def event_episodes(queries: DataFrame, derivatives: DataFrame, segments: DataFrame, limit: int, threshold: float | None = None, metric: str | None = None, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """query_id, episode_uid, score, rank: the best episodes by their best segment that reaches the threshold, `limit` at most.

    derivatives(uid, segment_uid, embedding), segments(uid, episode_uid, ...); the filter holds for segments.
    digits: the threshold is for scores rounded so.
    """
    hits = S.knn(queries, derivatives, limit * OVER_FETCH, metric, tie="uid")
    seeds = S.best_per_seed(hits, "segment_uid", metric)
    given = segments if where is None else segments.where(where)
    found = seeds.join(given.select(F.col("uid").alias("segment_uid"), "episode_uid"), "segment_uid")
    found = found.where(F.col("episode_uid").isNotNull() & V.passes(metric, F.col("score") if digits is None else F.round("score", digits), threshold))
    first = found.groupBy("query_id", "episode_uid").agg(F.min("seed_rank").alias("seed_rank"), F.min_by("score", "seed_rank").alias("score"))
    order = W.partitionBy("query_id").orderBy("seed_rank")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("seed_rank")


def hydrate(hits: DataFrame, episodes: DataFrame, key: str = "episode_uid", uid: str = "uid") -> DataFrame:
    """Hits with the columns of their episode; hits of episodes that are not there go (see drift)."""
    return hits.join(episodes.withColumnRenamed(uid, key), key)


def drift(hits: DataFrame, episodes: DataFrame, key: str = "episode_uid", uid: str = "uid") -> DataFrame:
    """Hits whose episode is not there: index and storage have drifted apart."""
    return hits.join(episodes.select(F.col(uid).alias(key)), key, "left_anti")


def declarative_episodes(queries: DataFrame, derivatives: DataFrame, sources: DataFrame, episodes: DataFrame, partition: list[str], most: int = 20, expand: int = 0, metric: str | None = None, threshold: float | None = None, score: Callable[[str, str], float] | None = None, text: str = "text", digits: int | None = None) -> DataFrame:
    """query_id, uid, score, position: declarative search, its contexts reranked if a function is given, above the threshold, in the order of time.

    A row's score is that of its context. queries need query_text where a function is given. digits: see search.best_per_seed.
    """
    if score is None:
        ranked = M.declarative_search(queries, derivatives, sources, episodes, partition, most, expand, metric, digits=digits)
    else:
        contexts = M.declarative_contexts(queries, derivatives, sources, episodes, partition, most, expand, metric, digits=digits)
        again = rescored(contexts, queries, score, ["ts", "uid"], text)
        ranked = C.budget_union(contexts.drop("score", "context_rank").join(again, ["query_id", "seed"]), most, ["query_id"], "uid")
    found = ranked if threshold is None else ranked.where(F.col("score") >= threshold)
    return found.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("ts", "uid")))


def with_agent_hits(hits: DataFrame, short: DataFrame, threshold: float, by: list[str], key: str = "uid", rank: str = "rank") -> DataFrame:
    """An agent's long-term hits, scored 1.0, once each and without what short-term memory holds; none if the threshold is above 1."""
    scored = hits.withColumn("score", F.lit(1.0)).where(F.lit(threshold) <= 1.0)
    return M.merge_terms(short, scored, key, rank, by)


def evidence_union(parts: list[DataFrame], by: list[str], key: str = "uid", time: str = "created_at") -> DataFrame:
    """Rows of all parts (evidence and retrieved episodes), once each, with their position in the order of time."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    once = whole.withColumn("__n", F.row_number().over(W.partitionBy(*by, key).orderBy(time))).where("__n = 1").drop("__n")
    return once.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(time, key)))


def bag(parts: list[DataFrame]) -> DataFrame:
    """All rows of sub-queries' results, repeats included."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def merged_metrics(metrics: DataFrame, by: list[str], numbers: list[str], lists: list[str]) -> DataFrame:
    """Metrics of several steps as one: numbers add up, lists are joined in the order of the steps (column step)."""
    joined = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("step", c))), lambda x: x[c])).alias(c)
    return metrics.groupBy(*by).agg(*[F.sum(c).alias(c) for c in numbers], *[joined(c) for c in lists])
