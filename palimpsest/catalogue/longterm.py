"""Long-term search, feature search, retrieval tools, rerankers over vectors and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions import vectors as V
from palimpsest.operators import agents as A
from palimpsest.operators import features as P
from palimpsest.operators import longterm as L
from palimpsest.operators import memory as M
from palimpsest.operators import rerank as R
from palimpsest.operators import search as S

from .common import messages, vector_queries, vectors
from .memory import DECLARATIVE_SQL
from .texts import _candidates
from .vectors import SCORES
from .vectors import _sql as knn_sql


def _segments(spark, sf) -> DataFrame:
    """Vectors as segments of episodes: three ids each, none for every seventh."""
    return vectors(spark, sf).select("uid", F.when(F.col("uid") % 7 != 0, F.col("uid") - F.col("uid") % 3).alias("episode_uid"), "label")


def _episodes(spark, sf) -> DataFrame:
    """The episodes, without every fifteenth: index and storage have drifted apart."""
    return vectors(spark, sf).where("uid % 3 = 0 AND uid % 15 <> 0").select("uid", F.concat(F.lit("episode "), "uid").alias("content"))


def _event(spark, sf):
    derivatives = vectors(spark, sf).withColumn("segment_uid", F.col("uid"))
    return L.event_episodes(vector_queries(spark, sf), derivatives, _segments(spark, sf), 6, 0.1, where=F.col("label") < 8, digits=6)


def _event_search(spark, sf):
    return L.hydrate(_event(spark, sf), _episodes(spark, sf)).select("query_id", "episode_uid", "content", F.round("score", 6).alias("score"), "rank")


def _drift(spark, sf):
    return L.drift(_event(spark, sf), _episodes(spark, sf)).select("query_id", "episode_uid", "rank")


LTM = (
    f"h AS ({knn_sql('cosine', 24)}), f AS (SELECT h.query_id, h.uid, h.score, uid - uid % 3 AS episode_uid, rank FROM h JOIN embeddings e ON e.vec_id = uid WHERE uid % 7 <> 0 AND e.label < 8 AND score >= 0.1), "
    "e AS (SELECT query_id, episode_uid, min(rank) AS first, max(score) AS score FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM e QUALIFY rank <= 6)"
)


def _declarative(spark, sf):
    sources = vectors(spark, sf).select("uid", (F.col("uid") - F.col("uid") % 2).alias("episode_uid"))
    rows = vectors(spark, sf).select("uid", F.floor(F.col("uid") / 100).alias("session"), F.col("label").alias("ts"))
    return L.declarative_episodes(vector_queries(spark, sf), vectors(spark, sf), sources, rows, ["session"], most=8, expand=3, threshold=0.2, digits=6).select("query_id", "uid", "position")


LTM_DECLARATIVE_SQL = (
    DECLARATIVE_SQL.replace("SELECT query_id, seed, context_rank, n.uid, n.i - a.i AS d FROM", "SELECT query_id, seed, context_rank, r.score, n.ts, n.uid, n.i - a.i AS d FROM")
    .replace("SELECT vec_id AS uid, vec_id // 100 AS session,", "SELECT vec_id AS uid, label AS ts, vec_id // 100 AS session,")
    .replace("SELECT query_id, uid, seed, CAST(d AS INTEGER) AS distance FROM g WHERE j <= 8", "SELECT query_id, uid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ts, uid) AS INTEGER) AS position FROM g WHERE j <= 8 AND score >= 0.2")
)


def _shared_words(query: str, text: str) -> float:
    return float(len(set(query.split(" ")) & set(text.split(" "))))


def _rescored(spark, sf):
    """Contexts of each conversation's first three turns, ranked by the words that they share with its last turn."""
    df = messages(spark, sf)
    queries = df.groupBy(F.col("session_key").alias("query_id")).agg(F.max_by("content", "sequence_num").alias("query_text"))
    seeds = df.where("sequence_num < 3").select(F.col("session_key").alias("query_id"), F.col("uid").alias("seed"), (F.col("sequence_num") + 1).alias("context_rank"))
    rows = df.select(F.col("session_key").alias("query_id"), F.col("sequence_num").alias("at"), F.col("content").alias("text"))
    contexts = seeds.join(rows, "query_id").where("at BETWEEN context_rank - 1 AND context_rank")
    return L.rescored(contexts, queries, _shared_words, ["at"]).select("query_id", "seed", "score", "context_rank")


RESCORED_SQL = """
WITH q AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations GROUP BY 1),
c AS (SELECT s.conv_id, s.conv_id * 1000 + s.turn AS seed, s.turn + 1 AS rank, string_agg(t.text, chr(10) ORDER BY t.turn) AS text FROM conversations s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn BETWEEN s.turn AND s.turn + 1 WHERE s.turn < 3 GROUP BY 1, 2, 3),
x AS (SELECT c.*, CAST(len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(string_split(text, ' ')))) AS DOUBLE) AS score FROM c JOIN q USING (conv_id))
SELECT conv_id AS query_id, seed, score, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, rank) AS INTEGER) AS context_rank FROM x
"""


def _agent(spark, sf):
    """An agent gives every turn, even ones twice; the last two are short-term memory."""
    df = messages(spark, sf)
    short = M.short_term(df, "session_key", ["sequence_num"], limit=2)
    hits = df.select("session_key", "uid", F.col("sequence_num").alias("rank")).union(df.where("uid % 2 = 0").select("session_key", "uid", F.lit(500).cast("long")))
    return L.with_agent_hits(hits, short, 0.5, ["session_key"]).select("session_key", "uid", "rank", "score")


def _by_first_word(spark, sf, n: int):
    """A tool: all turns, of all conversations, that begin with the query's n-th word, as one row with their number and the sum of their ids."""
    df = messages(spark, sf).select("uid", F.split("content", " ")[0].alias("word"))
    return A.totals_of_key(df, "word", F.get(F.split("query_text", " "), F.lit(n)), F.count("*").alias("n"), F.sum("uid").alias("uids"), F.max("uid").alias("uid"))


def _totals(found: DataFrame, *more) -> DataFrame:
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("uids").alias("uids"), *more)


def _queries(spark, sf) -> DataFrame:
    """Each conversation's first words of its first and second turn as a query."""
    df = messages(spark, sf).where("sequence_num < 2")
    words = F.transform(F.sort_array(F.collect_list(F.struct("sequence_num", F.split("content", " ")[0].alias("word")))), lambda x: x["word"])
    return df.groupBy(F.col("session_key").alias("query_id")).agg(F.array_join(words, " ").alias("query_text"))


def _split_query(spark, sf):
    tool = A.split_query(_by_first_word(spark, sf, 0), lambda q: q.split(" "))
    return _totals(tool(_queries(spark, sf)))


def _select_tool(spark, sf):
    tools = {"first": _by_first_word(spark, sf, 0), "second": _by_first_word(spark, sf, 1)}
    tool = A.select_tool(tools, lambda q: "second" if len(q) % 2 else "neither", "first")
    return _totals(tool(_queries(spark, sf)))


def _chain(spark, sf):
    """What the first word finds suffices if that is over ten turns; else the second word is asked for, as evidence beside it."""
    words = _by_first_word(spark, sf, 0)
    # turns of one first word are one piece of evidence, known by the newest of them; the judge is told how many they are
    tool = A.chain_of_queries(lambda queries: words(queries).withColumn("created_at", F.col("uid")).withColumn("content", F.col("n").cast("string")), lambda q, texts: (sum(map(int, texts)) > 10, 0.9, " ".join(q.split(" ")[1:]) or q), rounds=2)
    return _totals(tool(_queries(spark, sf)), F.sum("n").alias("last"))


WORDS = (
    "m AS (SELECT conv_id * 1000 + turn AS uid, conv_id, turn, string_split(text, ' ')[1] AS word, text FROM conversations), "
    "q AS (SELECT conv_id AS query_id, string_agg(word, ' ' ORDER BY turn) AS query, list(word ORDER BY turn) AS words FROM m WHERE turn < 2 GROUP BY 1)"
)
SPLIT_SQL = f"WITH {WORDS}, p AS (SELECT query_id, unnest(words) AS word FROM q) SELECT query_id, count(*) AS n, CAST(sum(uid) AS BIGINT) AS uids FROM p JOIN m USING (word) GROUP BY 1"
SELECT_SQL = f"WITH {WORDS}, p AS (SELECT query_id, CASE WHEN length(query) % 2 = 1 THEN words[2] ELSE words[1] END AS word FROM q) SELECT query_id, count(*) AS n, CAST(sum(uid) AS BIGINT) AS uids FROM p JOIN m USING (word) GROUP BY 1"
CHAIN_SQL = (
    f"WITH {WORDS}, a AS (SELECT query_id, count(*) AS found FROM q JOIN m ON m.word = words[1] GROUP BY 1), p AS (SELECT query_id, words[1] AS word FROM q UNION SELECT query_id, coalesce(words[2], words[1]) FROM q JOIN a USING (query_id) WHERE found <= 10), "
    "u AS (SELECT DISTINCT query_id, uid FROM p JOIN m USING (word)) SELECT query_id, count(*) AS n, CAST(sum(uid) AS BIGINT) AS uids, count(*) AS last FROM u GROUP BY 1"
)


def _evidence(spark, sf):
    df = messages(spark, sf).withColumn("created_at", F.col("sequence_num"))
    parts = [df.where("sequence_num % 2 = 0"), df.where("sequence_num % 3 = 0"), df.where("sequence_num < 2")]
    once = L.evidence_union(parts, ["session_key"]).select("session_key", "uid", "position", F.lit("union").alias("kind"))
    return once.unionByName(L.bag(parts).select("session_key", "uid", F.lit(0).alias("position"), F.lit("bag").alias("kind")))


EVIDENCE_SQL = """
WITH b AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn FROM conversations WHERE turn < 2)
SELECT conv_id AS session_key, conv_id * 1000 + turn AS uid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, 'union' AS kind FROM (SELECT DISTINCT * FROM b) UNION ALL SELECT conv_id, conv_id * 1000 + turn, 0, 'bag' FROM b
"""


def _metrics(spark, sf):
    df = messages(spark, sf).select("session_key", F.col("sequence_num").alias("step"), F.length("content").cast("long").alias("chars"), F.array("sequence_num", F.lit(0).cast("long")).alias("seen"))
    return L.merged_metrics(df, ["session_key"], ["chars"], ["seen"]).select("session_key", "chars", F.concat_ws(",", F.col("seen").cast("array<string>")).alias("seen"))


def _feature_search(spark, sf):
    """The third page of ten of the vectors' labels as features."""
    features = vectors(spark, sf).select(F.col("uid").alias("id"), F.concat(F.lit("tag"), "label").alias("tag"))
    found = P.feature_search(vector_queries(spark, sf), vectors(spark, sf).withColumnRenamed("uid", "id"), features, 10, 2, -0.5, F.col("tag") != "tag3")
    return found.select("query_id", "id", "tag", "position", F.round("score", 6).alias("score"))


FEATURE_SEARCH_SQL = (
    f"WITH x AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, {SCORES['cosine']} AS s FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) - 1 AS position FROM x WHERE label <> 3 AND s >= -0.5) SELECT query_id, id, 'tag' || label AS tag, CAST(position AS INTEGER) AS position, round(s, 6) AS score FROM y WHERE position >= 20 AND position < 30"
)


def _batch(spark, sf):
    """Every twentieth vector as a query against all."""
    return S.knn(vector_queries(spark, sf), vectors(spark, sf), 5).select("query_id", "rank", "uid", F.round("score", 6).alias("score"))


def _by_label(spark, sf) -> DataFrame:
    """Each label's vectors as a list whose query is its least id's vector."""
    df = vectors(spark, sf)
    query = df.groupBy("label").agg(F.min_by("embedding", "uid").alias("query_vector"))
    return df.join(query, "label").select(F.col("label").alias("query_id"), F.col("uid").alias("pos"), "query_vector", "embedding")


def _by_embedding(spark, sf):
    given = _by_label(spark, sf)
    parts = [R.by_embedding(given, m).withColumn("metric", F.lit(m)) for m in V.METRICS]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return whole.select("query_id", "pos", "metric", F.round("score", 5).alias("score"))


BY_EMBEDDING_SQL = "WITH l AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT c.label AS query_id, c.vec_id AS pos, '{m}' AS metric, round({'-' if m in ('l1', 'l2') else ''}({s}), 5) AS score FROM embeddings c JOIN l q ON q.label = c.label" for m, s in SCORES.items()
)


def _conversions(spark, sf):
    hits = S.scored(vector_queries(spark, sf), vectors(spark, sf), metric="l2")
    square = F.col("score") * F.col("score")
    back = V.distance_of_score(V.score_of_distance(square, "l2", squared=True), "l2", squared=True)
    return hits.select("query_id", "uid", F.round(V.score_of_distance(square, "l2", squared=True), 5).alias("l2"), F.round(back, 4).alias("squared"), F.round(V.score_of_distance(F.col("score"), "cosine"), 5).alias("cosine"))


CONVERSIONS_SQL = f"SELECT q.vec_id AS query_id, c.vec_id AS uid, round({SCORES['l2']}, 5) AS l2, round({SCORES['l2']} * {SCORES['l2']}, 4) AS squared, round(1 - {SCORES['l2']}, 5) AS cosine FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0"


def _adjacent_scores(spark, sf):
    found = R.adjacent_scores(messages(spark, sf), ["session_key"], ["sequence_num"], _shared_words)
    return found.select("uid", "score")


ADJACENT_SQL = "WITH a AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT conv_id * 1000 + turn AS uid, CAST(len(list_intersect(list_distinct(string_split(text, ' ')), list_distinct(string_split(next, ' ')))) AS DOUBLE) * CASE WHEN next IS NOT NULL THEN 1 END AS score FROM a"


def _stop_words(spark, sf):
    """Words that are no stop words, of every turn."""
    return messages(spark, sf).select("uid", F.size(R.english_tokens(F.concat(F.lit("The cat, and it's a "), F.col("content")))).alias("n"), F.size(R.simple_tokens(F.col("content"))).alias("every"))


def _blank(spark, sf):
    given = _candidates(spark, sf).withColumn("text", F.when(F.col("pos") % 3 != 1, F.col("text")).otherwise(" "))
    scores = R.by_model(given.where("trim(text) <> ''"), lambda q, t: float(len(t)))
    return R.blank_as_zero(given, scores)


def _chunked_model(spark, sf):
    """The best of each turn's chunks of 200 characters by the words that it shares with the query."""
    return R.by_model(_candidates(spark, sf), _shared_words, lambda text: X.chunks(text, 200))


CHUNKED_SQL = """
WITH q AS (SELECT conv_id, list_distinct(string_split(arg_min(text, turn), ' ')) AS query FROM conversations GROUP BY 1),
c AS (SELECT conv_id, turn, unnest(CASE WHEN text = '' THEN [''] ELSE list_transform(range(CAST(ceil(length(text) / 200.0) AS BIGINT)), lambda k: substring(text, k * 200 + 1, 200)) END) AS piece FROM conversations)
SELECT conv_id AS query_id, turn AS pos, CAST(max(len(list_intersect(query, list_distinct(string_split(piece, ' '))))) AS DOUBLE) AS score FROM c JOIN q USING (conv_id) GROUP BY 1, 2
"""


QUERIES = {
    "ltm_event_search": (_event_search, f"WITH {LTM} SELECT query_id, episode_uid, 'episode ' || episode_uid AS content, score, CAST(rank AS INTEGER) AS rank FROM r WHERE episode_uid % 15 <> 0"),
    "ltm_drift": (_drift, f"WITH {LTM} SELECT query_id, episode_uid, CAST(rank AS INTEGER) AS rank FROM r WHERE episode_uid % 15 = 0"),
    "ltm_declarative_search": (_declarative, LTM_DECLARATIVE_SQL),
    "ltm_rescored": (_rescored, RESCORED_SQL),
    "ltm_agent_hits": (_agent, "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) SELECT conv_id AS session_key, conv_id * 1000 + turn AS uid, turn AS rank, 1.0::DOUBLE AS score FROM m WHERE p > 2"),
    "ltm_evidence_union": (_evidence, EVIDENCE_SQL),
    "agent_split_query": (_split_query, SPLIT_SQL),
    "agent_select_tool": (_select_tool, SELECT_SQL),
    "agent_chain_of_queries": (_chain, CHAIN_SQL),
    "agent_metrics": (_metrics, "SELECT conv_id AS session_key, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(turn || ',0', ',' ORDER BY turn) AS seen FROM conversations GROUP BY 1"),
    "feat_vector_search": (_feature_search, FEATURE_SEARCH_SQL),
    "vec_batch": (_batch, knn_sql("cosine", 5)),
    "vec_conversions": (_conversions, CONVERSIONS_SQL),
    "rank_embedding": (_by_embedding, BY_EMBEDDING_SQL),
    "rank_stop_words": (_stop_words, None),
    "rank_blank": (_blank, "SELECT conv_id AS query_id, turn AS pos, CASE WHEN turn % 3 = 1 THEN 0 ELSE CAST(length(text) AS DOUBLE) END AS score FROM conversations"),
    "rank_model_chunked": (_chunked_model, CHUNKED_SQL),
    "cluster_adjacent_reranker": (_adjacent_scores, ADJACENT_SQL),
}
