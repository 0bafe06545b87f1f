"""Scores of evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import scoring as S
from palimpsest.session import read

from .common import episodes


def _judged(spark, sf):
    return read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("score", F.col("quality") * 0.75 + F.col("toxic") * 0.125)


def _levels(spark, sf):
    return S.by_level(_judged(spark, sf), "lang", "source", "score")


def _tools(spark, sf):
    df = episodes(spark, sf)
    return S.tool_report(df, "producer_role", F.col("value") < 30, F.col("k") % 4, F.lit(4).cast("long"), F.col("k") % 10)


def _latency(spark, sf):
    return S.latency(episodes(spark, sf), ["producer_role"], "value").select("producer_role", F.round("mean", 6).alias("mean"), F.round("iqr", 6).alias("iqr"))


def _kendall(spark, sf):
    """Two rankings of a user's events: by id and by value; some are missing from the second."""
    df = episodes(spark, sf).withColumn("rank_a", F.row_number().over(S.W.partitionBy("session_key").orderBy("uid")))
    ranked = df.withColumn("rank_b", F.row_number().over(S.W.partitionBy("session_key").orderBy("value", "uid")))
    given = ranked.select("session_key", F.col("uid").alias("item"), "rank_a", F.when(F.col("uid") % 5 != 0, F.col("rank_b")).alias("rank_b"))
    return S.kendall(given, ["session_key"]).select("session_key", *[F.round(c, 6).alias(c) for c in ("tau", "normalised", "score")])


KENDALL_SQL = """
WITH a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ra FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rb FROM a),
m AS (SELECT user_id, event_id, ra, CASE WHEN event_id % 5 <> 0 THEN rb END AS rb FROM b),
f AS (SELECT user_id, event_id, ra, coalesce(rb, max(rb) OVER (PARTITION BY user_id) + 1) AS rb FROM m), g AS (SELECT user_id, 2.0 * count(rb) / (count(*) + count(rb)) AS f1 FROM m GROUP BY 1),
p AS (SELECT x.user_id, sign(x.ra - y.ra) AS da, sign(x.rb - y.rb) AS db FROM f x JOIN f y ON x.user_id = y.user_id AND x.event_id < y.event_id),
s AS (SELECT user_id, sum(da * db) AS s, sum(abs(da)) AS na, sum(abs(db)) AS nb FROM p GROUP BY 1),
t AS (SELECT user_id, f1, CASE WHEN na * nb > 0 THEN s / sqrt(na * nb) ELSE 0 END AS tau FROM g LEFT JOIN s USING (user_id))
SELECT user_id AS session_key, round(coalesce(tau, 0), 6) AS tau, round((coalesce(tau, 0) + 1) / 2, 6) AS normalised, round((coalesce(tau, 0) + 1) / 2 * f1, 6) AS score FROM t
"""


def _facts(spark, sf):
    """Whether a turn, as a fact, is found in the next one, and token overlaps."""
    df = read(spark, sf, "conversations")
    w = S.W.partitionBy("conv_id").orderBy("turn")
    given = df.withColumn("after", F.lead("text").over(w)).where("after IS NOT NULL")
    a, b = X.tokens(F.col("text")), X.tokens(F.col("after"))
    return given.select("conv_id", "turn", F.size(a).alias("n_fact"), F.size(F.array_intersect(a, b)).alias("n_both"), X.fact_in_text(F.col("text"), F.col("after")).alias("found"))


FACTS_SQL = r"""
WITH c AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
t AS (SELECT conv_id, turn, text, after, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS a, list_distinct(regexp_extract_all(lower(after), '[a-z0-9]{3,}')) AS b, trim(lower(regexp_replace(after, '\s+', ' ', 'g'))) AS norm_after,
  trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS v1, trim(lower(regexp_replace(CASE WHEN contains(text, ':') THEN trim(substring(text, strpos(text, ':') + 1)) ELSE text END, '\s+', ' ', 'g'))) AS v2 FROM c WHERE after IS NOT NULL),
l AS (SELECT conv_id, turn, bool_or(len(x) >= 5 AND len(list_intersect(x, a)) >= 0.6 * len(a)) AS near FROM (SELECT conv_id, turn, a, list_distinct(regexp_extract_all(lower(unnest(string_split(after, chr(10)))), '[a-z0-9]{3,}')) AS x FROM t) GROUP BY 1, 2)
SELECT conv_id, turn, CAST(len(a) AS INTEGER) AS n_fact, CAST(len(list_intersect(a, b)) AS INTEGER) AS n_both, (v1 <> '' AND contains(norm_after, v1)) OR (v2 <> '' AND contains(norm_after, v2)) OR (len(a) > 0 AND near) AS found FROM t JOIN l USING (conv_id, turn)
"""


def _sets(spark, sf):
    df = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 10).alias("a"), F.collect_set(F.col("l_suppkey") % 10).alias("b"))
    p, r, f = S.set_scores(F.col("a"), F.col("b"))
    return df.select("l_orderkey", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


SETS_SQL = """
WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey % 10)) AS a, list_distinct(list(l_suppkey % 10)) AS b FROM lineitem GROUP BY 1),
h AS (SELECT l_orderkey, len(list_intersect(a, b))::DOUBLE / len(b) AS p, len(list_intersect(a, b))::DOUBLE / len(a) AS r FROM s)
SELECT l_orderkey, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM h
"""


def _rubric(spark, sf):
    return S.rubric(_judged(spark, sf), ["lang"], "score")


JUDGED = "SELECT l.*, lang, source, quality * 0.75 + toxic * 0.125 AS score FROM labels l JOIN documents USING (doc_id)"

QUERIES = {
    "score_by_group": (_levels, f"SELECT lang, source, round(avg(score), 4) AS mean, count(*) AS n, CAST(grouping_id(lang, source) AS INTEGER) AS level FROM ({JUDGED}) GROUP BY GROUPING SETS ((lang), (source), ())"),
    "score_rubric": (_rubric, f"SELECT lang, round(coalesce(avg(score), 0), 4) AS score FROM ({JUDGED}) GROUP BY 1"),
    "score_tools": (_tools, "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type AS producer_role, count(*) AS n, round(sum(CASE WHEN value < 30 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS accuracy, round(sum(k % 4) / (4.0 * count(*)), 6) AS recall, round(sum(k % 4) / sum(k % 10)::DOUBLE, 6) AS precision FROM e GROUP BY 1"),
    "score_latency": (_latency, "SELECT event_type AS producer_role, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1"),
    "score_kendall": (_kendall, KENDALL_SQL),
    "score_sets": (_sets, SETS_SQL),
    "score_fact_overlap": (_facts, FACTS_SQL),
}
