"""Rerankers over lists of candidates: rows (query_id, query, pos, text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import vectors as V


def simple_tokens(text: Column) -> Column:
    """Lower-case words."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"\W+", " ")), " "), lambda x: x != "")


def english_tokens(text: Column) -> Column:
    """Lower-case words without English stop words (Spark's own list)."""
    from pyspark.ml.feature import StopWordsRemover

    # apostrophes are no word characters, so the list's contractions are met in parts
    stop = sorted({part for word in StopWordsRemover.loadDefaultStopWords("english") for part in word.lower().split("'") if part})
    return F.filter(simple_tokens(text), lambda x: ~x.isin(stop))


def bm25(candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tokens: Callable[[Column], Column] = simple_tokens) -> DataFrame:
    """query_id, pos, score by Okapi BM25 over each query's own candidates.

    Negative idf becomes epsilon times the mean idf of the list's words. A query
    word counts as often as it is given. Lists of empty texts score 0.
    """
    given = candidates.select("query_id", "pos", tokens(F.col("query")).alias("wanted"), tokens(F.col("text")).alias("words"))
    per_list = W.partitionBy("query_id")
    sized = given.withColumn("dl", F.size("words")).withColumns({"n": F.count("*").over(per_list), "avgdl": F.avg("dl").over(per_list)})
    tf = sized.select("query_id", "pos", "dl", "n", "avgdl", F.explode("words").alias("word")).groupBy("query_id", "pos", "dl", "n", "avgdl", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "n", "word").agg(F.count("*").alias("df"))
    idf = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = idf.withColumn("mean", F.avg("idf").over(per_list)).withColumn("idf", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf"))).select("query_id", "word", "idf")
    query = given.groupBy("query_id").agg(F.first("wanted").alias("wanted")).select("query_id", F.explode("wanted").alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
    hits = tf.join(query, ["query_id", "word"]).join(idf, ["query_id", "word"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", "pos").agg(F.sum(part).alias("score"))
    return given.select("query_id", "pos").join(scores, ["query_id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def reciprocal_ranks(scored: DataFrame, k: int = 60) -> DataFrame:
    """query_id, text, score: the sum of 1 / (k + rank) over rankers and occurrences of a text. Rows: (query_id, ranker, pos, text, score)."""
    order = W.partitionBy("query_id", "ranker").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).groupBy("query_id", "text").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def identity(candidates: DataFrame) -> DataFrame:
    """Scores that keep the given order: n - 1 down to 0."""
    n = F.count("*").over(W.partitionBy("query_id"))
    return candidates.withColumn("score", (n - F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).cast("double"))


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """The candidates with their rank by score, equal scores in the given order."""
    return candidates.join(scores, ["query_id", "pos"]).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pos")))


def by_model(candidates: DataFrame, score: Callable[[str, str], float], chunk: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, pos, score of a cross-encoder given as a function; with chunks, the best chunk counts."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            yield pd.Series([float(score(q or "", t or "")) for q, t in zip(queries, texts)])

    pieces = candidates.withColumn("__piece", F.explode_outer(chunk(F.col("text"))) if chunk else F.col("text"))
    return pieces.groupBy("query_id", "pos").agg(F.max(run("query", "__piece")).alias("score"))


def by_embedding(candidates: DataFrame, metric: str | None = None) -> DataFrame:
    """query_id, pos, score of candidates (query_id, pos, query_vector, embedding): similarity, distances negated so that more is better."""
    score = V.similarity(F.col("query_vector"), F.col("embedding"), metric)
    return candidates.select("query_id", "pos", (score if V.higher_is_better(metric) else -score).alias("score"))


def adjacent_scores(events: DataFrame, cluster: list[str], order: list[str], score: Callable[[str, str], float], text: str = "content") -> DataFrame:
    """Each event with the score of the next one of its cluster for it as the query; null for the last."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            yield pd.Series([None if t is None else float(score(q or "", t)) for q, t in zip(queries, texts)], dtype="float64")

    following = F.lead(text).over(W.partitionBy(*cluster).orderBy(*order))
    return events.withColumn("__next", following).withColumn("score", run(text, "__next")).drop("__next")


def by_reply(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """query_id, pos, score of a remote reranker's replies (query_id, results array of struct(index, score)), which name candidates by their place in the request and in any order.

    Candidates (query_id, pos) are asked for in the order of pos. One that no result
    names gets 0, one that several name the score of the last; places beyond the request do not matter.
    """
    asked = candidates.select("query_id", "pos", (F.row_number().over(W.partitionBy("query_id").orderBy("pos")) - 1).alias("index"))
    results = replies.select("query_id", F.posexplode("results").alias("at", "r")).groupBy("query_id", F.col("r.index").alias("index")).agg(F.max_by("r.score", "at").alias("score"))
    return asked.join(results, ["query_id", "index"], "left").select("query_id", "pos", F.coalesce("score", F.lit(0.0)).alias("score"))


def blank_as_zero(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """query_id, pos, score: the scores, and 0 for blank candidates, which a remote reranker is not asked for."""
    given = candidates.select("query_id", "pos", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("__blank"))
    joined = given.join(scores, ["query_id", "pos"], "left")
    return joined.select("query_id", "pos", F.when(F.col("__blank"), 0.0).otherwise(F.col("score")).alias("score"))
