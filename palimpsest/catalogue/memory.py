"""Short-term memory, search pipelines, clusters and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import clusters as K
from palimpsest.operators import features as P
from palimpsest.operators import memory as M
from palimpsest.session import fresh_path, read
from palimpsest.streaming import ingest as I

from .common import HISTORY_SQL, episodes, messages, vector_queries, vectors
from .vectors import _sql as knn_sql


def _stm(spark, sf):
    return M.short_term(messages(spark, sf), "session_key", ["sequence_num"], most_chars=400, limit=3, summary_chars=F.lit(50)).select("uid", "session_key", "position")


def _stm_filtered(spark, sf):
    return M.short_term(messages(spark, sf), "session_key", ["sequence_num"], most_chars=300, where=F.col("producer_role") == "user").select("uid", "session_key", "position")


def _stm_sql(condition: str, start: int, most: int, limit: int) -> str:
    return (
        f"WITH m AS (SELECT conv_id * 1000 + turn AS uid, conv_id AS session_key, row_number() OVER w AS position, sum(length(text)) OVER w + {start} AS chars FROM conversations WHERE {condition} "
        f"WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) SELECT uid, session_key, CAST(position AS INTEGER) AS position FROM m WHERE chars <= {most} AND position <= {limit}"
    )


def _evict(spark, sf):
    return M.evicted(messages(spark, sf).withColumn("summarised", F.col("sequence_num") < 3), "session_key", ["sequence_num"], 300).select("uid", "session_key")


EVICT_SQL = "WITH m AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS chars FROM conversations) SELECT conv_id * 1000 + turn AS uid, conv_id AS session_key FROM m WHERE chars > 300 AND turn < 3"


def _merge(spark, sf):
    df = messages(spark, sf)
    short = M.short_term(df, "session_key", ["sequence_num"], limit=2)
    long = df.select("uid", "session_key", F.col("sequence_num").alias("rank")).union(df.where("sequence_num % 2 = 0").select("uid", "session_key", F.lit(100).cast("long")))
    return M.merge_terms(short, long).select("uid", "rank")


MERGE_SQL = "WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) SELECT conv_id * 1000 + turn AS uid, turn AS rank FROM m WHERE p > 2"


def _segments(spark, sf) -> DataFrame:
    """Vectors as segments of sessions of a hundred ids, ordered by label and id."""
    return vectors(spark, sf).select("uid", F.floor(F.col("uid") / 100).alias("session"), F.col("label").alias("ts"), F.col("uid").alias("event_uid"), F.lit(0).alias("index"), F.lit(0).alias("offset"))


def _event_search(spark, sf):
    derivatives = vectors(spark, sf).withColumn("segment_uid", F.col("uid") - F.col("uid") % 2)
    found = M.event_search(vector_queries(spark, sf), derivatives, _segments(spark, sf), ["session"], limit=10, expand=4, digits=6)
    return found.select("query_id", "seed", "context_rank", "uid", "distance", "score")


SEEDS_SQL = "s AS (SELECT query_id, uid - uid % 2 AS seed, max(score) AS score FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seed) AS context_rank FROM s)"
EVENT_SQL = (
    f"WITH h AS ({knn_sql('cosine', 10)}), {SEEDS_SQL}, n AS (SELECT vec_id AS uid, vec_id // 100 AS session, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY label, vec_id) AS i FROM embeddings) "
    "SELECT query_id, seed, CAST(context_rank AS INTEGER) AS context_rank, n.uid, CAST(n.i - a.i AS INTEGER) AS distance, score FROM r JOIN n a ON a.uid = seed JOIN n ON n.session = a.session AND n.i BETWEEN a.i - 1 AND a.i + 3"
)


def _declarative_search(spark, sf):
    sources = vectors(spark, sf).select("uid", (F.col("uid") - F.col("uid") % 2).alias("episode_uid"))
    rows = vectors(spark, sf).select("uid", F.floor(F.col("uid") / 100).alias("session"), F.col("label").alias("ts"))
    return M.declarative_search(vector_queries(spark, sf), vectors(spark, sf), sources, rows, ["session"], most=8, expand=3, digits=6).select("query_id", "uid", "seed", "distance")


DECLARATIVE_SQL = (
    f"WITH h AS ({knn_sql('cosine', 40)}), {SEEDS_SQL}, n AS (SELECT vec_id AS uid, vec_id // 100 AS session, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY label, vec_id) AS i FROM embeddings), "
    "c AS (SELECT query_id, seed, context_rank, n.uid, n.i - a.i AS d FROM r JOIN n a ON a.uid = seed JOIN n ON n.session = a.session AND n.i BETWEEN a.i - 1 AND a.i + 2), "
    "o AS (SELECT *, CASE WHEN d >= 0 THEN (d - 0.5) / 2 ELSE -d END AS p FROM c), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY query_id, uid ORDER BY context_rank, p) AS k FROM o), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY context_rank, p, uid) AS j FROM f WHERE k = 1) "
    "SELECT query_id, uid, seed, CAST(d AS INTEGER) AS distance FROM g WHERE j <= 8"
)


def _final(spark, sf):
    df = episodes(spark, sf).withColumn("ts", F.col("created_at"))
    return M.final_rerank(df, 4, ["session_key"], "value").select("session_key", "uid", "position")


FINAL_SQL = "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS n FROM events) SELECT user_id AS session_key, event_id AS uid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position FROM a WHERE n <= 4"


def _events_with_vectors(spark, sf) -> DataFrame:
    """Vectors in the order of their ids, a minute apart, ten minutes after each eleventh; the label is the cluster."""
    return vectors(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("uid") * 60 + F.floor(F.col("uid") / 11) * 540))


def _adjacent(spark, sf):
    found = K.adjacent(_events_with_vectors(spark, sf), ["label"], ["ts", "uid"])
    return K.signals(found, ["label"]).select("label", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "deviation")])


PAIRS_SQL = "p AS (SELECT vec_id, label, embedding, lead(embedding) OVER w AS next, epoch_s, lead(epoch_s) OVER w - epoch_s AS gap FROM (SELECT *, vec_id * 60 + (vec_id // 11) * 540 AS epoch_s FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY epoch_s, vec_id)), s AS (SELECT vec_id, label, epoch_s, abs(gap) AS gap, CASE WHEN next IS NOT NULL THEN list_cosine_similarity(embedding::DOUBLE[], next::DOUBLE[]) END AS sim FROM p)"
ADJACENT_SQL = f"WITH {PAIRS_SQL} SELECT label, count(*) AS n, round(min(sim), 6) AS low, round(max(sim), 6) AS high, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS deviation FROM s GROUP BY 1"


def _split(spark, sf):
    found = K.adjacent(_events_with_vectors(spark, sf), ["label"], ["ts", "uid"])
    return K.split_segments(found, ["label"], ["ts", "uid"], at_most=0.2, max_gap=2500.0).select("label", "uid", F.col("segment").cast("long").alias("segment"))


SPLIT_SQL = (
    f"WITH {PAIRS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY epoch_s, vec_id) AS n FROM s QUALIFY n <= 20), "
    "m AS (SELECT *, min(sim) OVER g AS lo, max(sim) OVER g AS hi, avg(sim) OVER g AS mean, stddev_pop(sim) OVER g AS sd, max(n) OVER g AS last FROM f WINDOW g AS (PARTITION BY label)), "
    "c AS (SELECT *, CASE WHEN n = last THEN 0 WHEN coalesce((CASE WHEN hi = lo THEN 1.0 ELSE (sim - lo) / (hi - lo) END) <= 0.2, false) OR coalesce(gap > 2500, false) OR coalesce(sd > 0 AND (mean - sim) / sd >= 2, false) THEN 1 ELSE 0 END AS cut FROM m) "
    "SELECT label, vec_id AS uid, CAST(coalesce(sum(cut) OVER (PARTITION BY label ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM c"
)


def _centroids(spark, sf):
    found = K.centroids(_events_with_vectors(spark, sf), ["label"])
    return found.select("label", "n", F.posexplode("centroid").alias("place", "x")).select("label", "n", "place", F.round("x", 6).alias("x"))


CENTROID_SQL = "WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings) SELECT label, count(*) AS n, CAST(place AS INTEGER) AS place, round(avg(x::DOUBLE), 6) AS x FROM u GROUP BY label, place"


def _online(spark, sf):
    return K.online(_events_with_vectors(spark, sf), "label", "uid", threshold=0.15)


# streams: each runs over what is there now, and must equal the batch result


def _event_stream(spark, sf) -> DataFrame:
    given = read(spark, sf, "events")
    path = fresh_path(spark, "source")
    given.repartition(4, "event_id").write.parquet(path)
    return I.files(spark, path, given.schema, 1)


def _ingest(spark, sf):
    stream = _event_stream(spark, sf).where("event_type <> 'error'").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    out = fresh_path(spark, "ingested")
    I.drain(I.into_batches(stream, out), fresh_path(spark, "state"))
    return I.read_batches(spark, out, stream.schema)


def _dedupe(spark, sf):
    stream = I.once(_event_stream(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"])
    out = fresh_path(spark, "once")
    I.drain(I.into_batches(stream, out), fresh_path(spark, "state"))
    return I.read_batches(spark, out, stream.schema)


def _trigger(spark, sf):
    """History rows arrive; sets are due by the history as it is after each batch."""
    given = read(spark, sf, "events")
    source, store, due = fresh_path(spark, "source"), fresh_path(spark, "history"), fresh_path(spark, "due")
    given.selectExpr("concat('user_', user_id) AS set_id", "cast(event_id AS string) AS history_id", "cast(ts AS timestamp) AS created_at", "(event_id % 3 <> 0 OR user_id % 4 = 0) AS ingested").repartition(4, "set_id").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = I.files(spark, source, schema, 1)

    I.drain(I.into_batches(stream, store), fresh_path(spark, "state"))
    write = lambda found, number: found.write.mode("overwrite").parquet(f"{due}/batch={number}")
    I.drain(I.due_sets(stream, 30, write, lambda: I.read_batches(spark, store, schema), F.to_timestamp(F.lit("2024-01-02 00:00:00"))), fresh_path(spark, "state"))
    return I.read_batches(spark, due, "set_id string").distinct()


def _commands(spark, sf):
    log = _event_stream(spark, sf).select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("command"), F.col("user_id").alias("set_id"), "value")
    out = fresh_path(spark, "log")
    I.drain(I.into_batches(log, out), fresh_path(spark, "state"))
    stored = I.read_batches(spark, out, log.schema)
    return P.apply_commands(stored.select("set_id", "value").limit(0), stored, ["set_id"]).select("set_id", "seq")


def _cluster_stream(spark, sf):
    """One batch per file, files dealt by label, so each cluster sees its events in order."""
    given = _events_with_vectors(spark, sf).select(F.col("label").cast("long").alias("set_id"), F.col("uid").alias("event_id"), "ts", F.col("embedding").cast("array<double>").alias("embedding"))
    source, out = fresh_path(spark, "source"), fresh_path(spark, "clusters")
    given.repartition(4, "set_id").write.parquet(source)
    stream = I.online_clusters(I.files(spark, source, given.schema, 1), 0.15)
    I.drain(I.into_batches(stream, out).outputMode("append"), fresh_path(spark, "state"))
    return I.read_batches(spark, out, "set_id long, event_id long, cluster int")


def _stm_stream(spark, sf):
    """Messages in batches dealt by session; how many of a session are summarised after each."""
    given = messages(spark, sf).select(F.col("session_key").cast("long").alias("session_key"), F.col("sequence_num").cast("long").alias("sequence_num"), "content")
    source, out = fresh_path(spark, "source"), fresh_path(spark, "stm")
    given.repartition(4, "session_key").write.parquet(source)
    I.drain(I.into_batches(I.short_term_state(I.files(spark, source, given.schema, 1), 1200), out), fresh_path(spark, "state"))
    return I.read_batches(spark, out, "session_key long, sequence_num long, summarised long")


STM_STREAM_SQL = """
WITH c AS (SELECT a.conv_id, a.turn, b.turn AS from_turn, sum(length(m.text)) AS chars FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn <= a.turn JOIN conversations m ON m.conv_id = a.conv_id AND m.turn BETWEEN b.turn AND a.turn GROUP BY ALL)
SELECT conv_id AS session_key, turn AS sequence_num, count(*) FILTER (chars > 1200) AS summarised FROM c GROUP BY 1, 2
"""


QUERIES = {
    "stream_short_term": (_stm_stream, STM_STREAM_SQL),
    "stm_context": (_stm, _stm_sql("true", 50, 400, 3)),
    "stm_context_filtered": (_stm_filtered, _stm_sql("role = 'user'", 0, 300, 1000000)),
    "stm_evict": (_evict, EVICT_SQL),
    "merge_stm_ltm": (_merge, MERGE_SQL),
    "event_search": (_event_search, EVENT_SQL),
    "declarative_search": (_declarative_search, DECLARATIVE_SQL),
    "final_rerank": (_final, FINAL_SQL),
    "cluster_adjacent": (_adjacent, ADJACENT_SQL),
    "cluster_split": (_split, SPLIT_SQL),
    "cluster_centroids": (_centroids, CENTROID_SQL),
    "cluster_online": (_online, None),
    "stream_ingest": (_ingest, "SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'"),
    "stream_dedupe": (_dedupe, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_trigger": (_trigger, f"SELECT set_id FROM ({HISTORY_SQL}) WHERE NOT ingested GROUP BY 1 HAVING count(*) >= 30 UNION SELECT set_id FROM ({HISTORY_SQL}) WHERE NOT ingested AND created_at <= TIMESTAMP '2024-01-02'"),
    "stream_commands": (_commands, "SELECT user_id AS set_id, event_id AS seq FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = e.user_id AND d.event_id > e.event_id)"),
    "stream_clusters": (_cluster_stream, None),
}
