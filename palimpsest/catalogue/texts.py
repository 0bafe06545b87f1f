"""Text functions and rerankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import ids as I
from palimpsest.functions import text as X
from palimpsest.operators import rerank as R
from palimpsest.session import read

from .common import episodes, messages


def _chunks(cut, size: int):
    def run(spark, sf):
        df = read(spark, sf, "conversations")
        return df.select("conv_id", "turn", F.posexplode(cut(F.col("text"), size)).alias("n", "chunk"))

    return run


def _chunk_sql(size: str) -> str:
    return f"WITH t AS (SELECT conv_id, turn, text, {size} AS s FROM conversations WHERE length(text) > 0), u AS (SELECT *, unnest(range(CAST(ceil(length(text) / s::DOUBLE) AS BIGINT))) AS n FROM t) SELECT conv_id, turn, CAST(n AS INTEGER) AS n, substring(text, n * s + 1, s) AS chunk FROM u"


def _sentences(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.sentences(F.col("text"))).alias("sentence"))


SENTENCE_SQL = r"SELECT DISTINCT conv_id, turn, trim(s) AS sentence FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^.?!？！。\n\r]+[.?!？！。]*')) AS s FROM conversations) WHERE regexp_matches(s, '[\p{L}\p{N}]')"


def _lines(spark, sf):
    df = episodes(spark, sf)
    return df.select("uid", X.line(F.col("created_at"), F.col("producer_role"), F.concat(F.lit("é \"value\" "), F.col("uid").cast("string"))).alias("line"))


LINE_SQL = """SELECT event_id AS uid, '[' || strftime(ts, '%A, %B %d, %Y at %I:%M %p') || '] ' || event_type || ': "é \\"value\\" ' || event_id || '"' AS line FROM events"""


def _times(spark, sf):
    df = episodes(spark, sf)
    given = df.select("uid", F.when(F.col("uid") % 3 == 0, F.lit("2024-03-01T10:20:30Z")).when(F.col("uid") % 3 == 1, (F.lit(1700000000) + F.col("uid")).cast("string")).otherwise(((F.lit(1700000000) + F.col("uid")) * 1000).cast("string")).alias("t"))
    return given.select("uid", F.unix_seconds(X.parsed_time(F.col("t"))).alias("seconds"))


def _keys(spark, sf):
    df = read(spark, sf, "customer").select(F.lower(F.regexp_replace("c_name", "#", "_")).alias("name"), "c_mktsegment")
    return df.select("name", I.partition_key(F.col("name")).alias("own"), I.partition_key(F.concat_ws("/", "c_mktsegment", "name")).alias("hashed"))


def _split_batches(spark, sf):
    """Pieces fit, and join to the text but for white space at their ends."""
    df = read(spark, sf, "documents").select("doc_id", X.segments("text").alias("s"))
    sizes = F.transform("s", lambda x: F.length(x))
    return df.select("doc_id", F.coalesce(F.array_max(sizes) <= 500, F.lit(True)).alias("fits"), F.sha2(F.regexp_replace(F.array_join("s", ""), r"\s+", ""), 256).alias("joined"))


def _candidates(spark, sf):
    """For each conversation its turns, with its first turn as the query."""
    df = messages(spark, sf)
    query = df.groupBy(F.col("session_key").alias("query_id")).agg(F.min_by("content", "sequence_num").alias("query"))
    return df.select(F.col("session_key").alias("query_id"), F.col("sequence_num").alias("pos"), F.col("content").alias("text")).join(query, "query_id")


def _bm25(spark, sf):
    return R.bm25(_candidates(spark, sf)).select("query_id", "pos", F.round("score", 5).alias("score"))


BM25_SQL = r"""
WITH q AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations GROUP BY 1),
c AS (SELECT conv_id, turn, list_filter(string_split(lower(regexp_replace(text, '[^a-zA-Z0-9_]+', ' ', 'g')), ' '), lambda x: x <> '') AS words, list_filter(string_split(lower(regexp_replace(query, '[^a-zA-Z0-9_]+', ' ', 'g')), ' '), lambda x: x <> '') AS wanted FROM conversations JOIN q USING (conv_id)),
l AS (SELECT *, len(words) AS dl, count(*) OVER (PARTITION BY conv_id) AS n, avg(len(words)) OVER (PARTITION BY conv_id) AS avgdl FROM c),
t AS (SELECT conv_id, turn, dl, n, avgdl, word, count(*) AS tf FROM (SELECT conv_id, turn, dl, n, avgdl, unnest(words) AS word FROM l) GROUP BY ALL),
d AS (SELECT conv_id, n, word, count(*) AS df FROM t GROUP BY ALL),
i0 AS (SELECT conv_id, word, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM d),
i AS (SELECT conv_id, word, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY conv_id) ELSE idf END AS idf FROM i0),
w AS (SELECT conv_id, word, count(*) AS times FROM (SELECT conv_id, unnest(any_value(wanted)) AS word FROM l GROUP BY 1) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM t JOIN w USING (conv_id, word) JOIN i USING (conv_id, word) GROUP BY ALL)
SELECT conv_id AS query_id, turn AS pos, round(coalesce(score, 0), 5) AS score FROM c LEFT JOIN s USING (conv_id, turn)
"""


def _rrf(spark, sf):
    """Two rankers of each conversation's turns: by length and by turn; texts that repeat add up."""
    given = _candidates(spark, sf)
    one = given.select("query_id", F.lit("length").alias("ranker"), "pos", "text", F.length("query").cast("double").alias("score"))
    two = given.select("query_id", F.lit("turn"), "pos", "text", F.col("pos").cast("double"))
    return R.reciprocal_ranks(one.union(two)).select("query_id", "text", F.round("score", 8).alias("score"))


RRF_SQL = """
WITH c AS (SELECT conv_id, turn, text FROM conversations),
r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM c UNION ALL SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) FROM c)
SELECT conv_id AS query_id, text, round(sum(1.0 / (60 + rank)), 8) AS score FROM r GROUP BY 1, 2
"""


def _identity(spark, sf):
    return R.identity(_candidates(spark, sf)).select("query_id", "pos", "score")


def _reranked(spark, sf):
    given = _candidates(spark, sf)
    scores = R.by_model(given, lambda query, text: float(len(set(query.split()) & set(text.split()))))
    return R.rerank(given, scores).select("query_id", "pos", "rank", "score")


MODEL_SQL = r"""
WITH q AS (SELECT conv_id, list_distinct(list_filter(regexp_split_to_array(arg_min(text, turn), '\s+'), lambda x: x <> '')) AS query FROM conversations GROUP BY 1),
s AS (SELECT conv_id, turn, CAST(len(list_intersect(query, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))) AS DOUBLE) AS score FROM conversations JOIN q USING (conv_id))
SELECT conv_id AS query_id, turn AS pos, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS INTEGER) AS rank, score FROM s
"""


def _normal(spark, sf):
    df = read(spark, sf, "conversations")
    return df.select("conv_id", "turn", F.sha2(X.normalised(F.col("text")), 256).alias("hash"))


QUERIES = {
    "text_chunk": (_chunks(X.chunks, 100), _chunk_sql("100")),
    "text_chunk_balanced": (_chunks(X.balanced_chunks, 100), _chunk_sql("CAST(ceil(length(text) / ceil(length(text) / 100.0)) AS BIGINT)")),
    "text_sentences": (_sentences, SENTENCE_SQL),
    "text_render_line": (_lines, LINE_SQL),
    "text_normalise_ts": (_times, "SELECT event_id AS uid, CASE event_id % 3 WHEN 0 THEN 1709288430 ELSE 1700000000 + event_id END AS seconds FROM events"),
    "text_partition_key": (_keys, "SELECT lower(replace(c_name, '#', '_')) AS name, CASE WHEN regexp_full_match(lower(replace(c_name, '#', '_')), '[a-z0-9_]+') AND length(c_name) <= 32 THEN lower(replace(c_name, '#', '_')) ELSE substring(sha256(lower(replace(c_name, '#', '_'))), 1, 32) END AS own, substring(sha256(c_mktsegment || '/' || lower(replace(c_name, '#', '_'))), 1, 32) AS hashed FROM customer"),
    "text_segments": (_split_batches, r"SELECT doc_id, true AS fits, sha256(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS joined FROM documents"),
    "text_normalise": (_normal, r"SELECT conv_id, turn, sha256(trim(lower(regexp_replace(text, '\s+', ' ', 'g')))) AS hash FROM conversations"),
    "rank_bm25": (_bm25, BM25_SQL),
    "rank_rrf": (_rrf, RRF_SQL),
    "rank_identity": (_identity, "SELECT conv_id AS query_id, turn AS pos, CAST(count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) AS score FROM conversations"),
    "rank_model": (_reranked, MODEL_SQL),
}
