"""Semantic ingestion, cluster state, model slots, metrics, exports."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from palimpsest.operators import graph as G
from palimpsest.operators import ingestion as N
from palimpsest.operators import metrics as E
from palimpsest.operators import models as L
from palimpsest.operators import tables as T
from palimpsest.session import fresh_path, read
from palimpsest.sources import chats

from .common import episodes, history, messages
from .memory import SPLIT_SQL, _events_with_vectors


def _commands(text: str) -> list[tuple[str, str, str, str]]:
    """Of an episode "role value": a feature of the role's name; errors delete purchases."""
    role, value = text.split(" ")
    return [("delete", "seen", "purchase", "")] if role == "error" else [("add", "seen", role, value)]


def _micro_batch(spark, sf):
    """A micro-batch of four rows of each set; every thirteenth episode is missing."""
    h = history(spark, sf)
    given = episodes(spark, sf).where("uid % 13 <> 0").select(F.col("uid").cast("string").alias("uid"), F.concat_ws(" ", "producer_role", (F.col("uid") % 10).cast("string")).alias("content"))
    none = h.select(F.col("history_id").alias("id"), "set_id", F.lit("").alias("tag"), F.lit("").alias("feature"), F.lit("").alias("value")).limit(0)
    after, left, cited = N.process_sets(h, given, none, none.select(F.col("id").alias("feature_id"), F.col("id").alias("history_id")), h.select("set_id"), _commands, 4)
    named = left.join(cited, F.col("id") == F.col("feature_id")).select("set_id", F.concat_ws(":", "feature", "value", "history_id").alias("what"))
    return named.union(after.groupBy("set_id").agg(F.concat_ws(":", F.count("*"), F.sum(F.col("ingested").cast("int"))).alias("what")))


MICRO_SQL = """
WITH h AS (SELECT 'user_' || user_id AS set_id, CAST(event_id AS VARCHAR) AS history_id, event_id, event_type, (event_id % 3 <> 0 OR user_id % 4 = 0) AS ingested FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY history_id) AS p FROM h WHERE NOT ingested QUALIFY p <= 4), k AS (SELECT * FROM b WHERE event_id % 13 <> 0),
l AS (SELECT * FROM k WHERE event_type <> 'error' AND NOT (event_type = 'purchase' AND EXISTS (SELECT 1 FROM k d WHERE d.set_id = k.set_id AND d.event_type = 'error' AND d.p > k.p)))
SELECT set_id, event_type || ':' || (event_id % 10) || ':' || history_id AS what FROM l
UNION ALL SELECT set_id, count(*) || ':' || count(*) FILTER (ingested OR history_id IN (SELECT history_id FROM k)) FROM h WHERE history_id NOT IN (SELECT history_id FROM b WHERE event_id % 13 = 0) GROUP BY 1
"""


def _state(spark, sf):
    """State is replaced for some sets, deleted for others, and loaded for a part."""
    old = read(spark, sf, "customer").select(F.col("c_custkey").alias("set_id"), F.lit("old").alias("state"))
    new = old.where("set_id % 3 = 0").select("set_id", F.explode(F.array(F.lit("new1"), F.lit("new2"))).alias("state"))
    kept = N.delete_state(N.save_state(old, new), old.where("set_id % 5 = 0").select("set_id"))
    return N.load_state(kept, old.where("set_id % 2 = 0").select("set_id"))


def _guarded(spark, sf):
    """Labels under 3 have a saved split of the same events, labels under 6 one of other events: only the first are replayed."""
    events = _events_with_vectors(spark, sf)
    none = events.select("label", "uid", F.lit("").alias("input_hash"), F.lit(0).cast("long").alias("segment")).limit(0)
    fresh = N.guarded_split(events, none, "label", "uid", ["ts", "uid"], at_most=0.2, max_gap=2500.0)
    saved = fresh.where("label < 3").withColumn("segment", F.col("segment") + 100).unionByName(fresh.where("label BETWEEN 3 AND 5").withColumn("input_hash", F.lit("other"))).drop("child")
    return N.guarded_split(events, saved, "label", "uid", ["ts", "uid"], at_most=0.2, max_gap=2500.0).select("label", "uid", "segment")


def _embedded(spark, sf):
    """A model that counts: the length, and the number of spaces, of each chunk of 300 characters."""
    given = messages(spark, sf).select("uid", F.when(F.col("uid") % 4 == 0, F.lit("<|special|> ")).otherwise(F.col("content")).alias("text"))
    found = L.embedded(given, lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts], "uid", most_chars=300, most_texts=3, most_request=700)
    return found.select("uid", F.round(F.col("embedding")[0], 6).alias("length"), F.round(F.col("embedding")[1], 6).alias("spaces"))


EMBEDDED_SQL = """
WITH t AS (SELECT conv_id * 1000 + turn AS uid, CASE WHEN (conv_id * 1000 + turn) % 4 = 0 OR trim(text) = '' THEN '.' ELSE trim(text) END AS text FROM conversations),
s AS (SELECT *, CAST(ceil(length(text) / ceil(length(text) / 300.0)) AS BIGINT) AS size FROM t), c AS (SELECT uid, substring(text, k * size + 1, size) AS chunk FROM (SELECT *, unnest(range(CAST(ceil(length(text) / size::DOUBLE) AS BIGINT))) AS k FROM s))
SELECT uid, round(avg(length(chunk)), 6) AS length, round(avg(length(chunk) - length(replace(chunk, ' ', ''))), 6) AS spaces FROM c GROUP BY 1
"""


def _generated(spark, sf):
    """A model that answers with a JSON object; its reply is parsed, its tokens counted."""
    reply = L.generated(F.col("content"), lambda p: ('so {"n": ' + str(len(p)) + ', "s": "}"} done', len(p.split(" ")), 3))
    found = messages(spark, sf).select("uid", reply.alias("r"))
    return found.select("uid", L.parsed_reply(F.col("r.reply"), "n long, s string")["n"].alias("n"), F.col("r.tokens_in").alias("tokens_in"), F.col("r.tokens_out").alias("tokens_out"))


def _derived(spark, sf):
    return L.derived(messages(spark, sf), lambda t: [x for x in t.split(" ")[:3] if len(x) > 2], "uid", "content")


def _coded(spark, sf):
    """Payloads compressed and decompressed are what they were."""
    given = messages(spark, sf).select("uid", F.when(F.col("uid") % 3 != 0, F.col("content")).alias("content"))
    packed = given.withColumn("packed", L.coded(F.col("content"), zlib.compress))
    return packed.select("uid", F.sha2(L.coded(F.col("packed"), zlib.decompress), 256).alias("hash"))


def _histogram(spark, sf):
    return E.histogram(episodes(spark, sf), ["producer_role"], "value", [10, 50.5, 100])


def _summary(spark, sf):
    found = E.summary(episodes(spark, sf), ["producer_role"], "value")
    return found.select("producer_role", "n", F.round("total", 4).alias("total"), "least", "greatest")


def _exported(spark, sf):
    """Messages exported in batches of 50 and read again."""
    path = fresh_path(spark, "export")
    chats.export_batches(messages(spark, sf), path, ["uid"], 50)
    return spark.read.json(path).select("batch", "uid")


def _numbered(spark, sf):
    return T.numbered(episodes(spark, sf), ["value", "uid"]).select("uid", "number")


def _added(spark, sf):
    nodes = read(spark, sf, "nation").select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("kind"))
    return G.add_nodes(nodes, read(spark, sf, "region").select((F.col("r_regionkey") + 100).cast(nodes.schema["uid"].dataType).alias("uid"), F.col("r_name").alias("kind")))


HISTOGRAM = " UNION ALL ".join(f"SELECT event_type AS producer_role, {b}::DOUBLE AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY 1" for b in (10, 50.5, 100))

QUERIES = {
    "feat_micro_batch": (_micro_batch, MICRO_SQL),
    "cluster_state": (_state, "SELECT c_custkey AS set_id, 'old' AS state FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, s FROM customer, (VALUES ('new1'), ('new2')) v(s) WHERE c_custkey % 6 = 0 AND c_custkey % 5 <> 0"),
    "cluster_split_guarded": (_guarded, f"SELECT label, uid, segment + CASE WHEN label < 3 THEN 100 ELSE 0 END AS segment FROM ({SPLIT_SQL})"),
    "model_embedder": (_embedded, EMBEDDED_SQL),
    "model_language": (_generated, "SELECT conv_id * 1000 + turn AS uid, length(text) AS n, len(string_split(text, ' ')) AS tokens_in, 3 AS tokens_out FROM conversations"),
    "model_deriver": (_derived, "WITH w AS (SELECT conv_id * 1000 + turn AS uid, list_filter(string_split(text, ' ')[1:3], lambda x: length(x) > 2) AS words FROM conversations) SELECT uid, CAST(k - 1 AS INTEGER) AS n, words[k] AS text FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM w)"),
    "model_codec": (_coded, "SELECT conv_id * 1000 + turn AS uid, CASE WHEN (conv_id * 1000 + turn) % 3 <> 0 THEN sha256(text) END AS hash FROM conversations"),
    "metric_histogram": (_histogram, f"{HISTOGRAM} UNION ALL SELECT event_type, NULL, count(*) FROM events GROUP BY 1"),
    "metric_summary": (_summary, "SELECT event_type AS producer_role, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1"),
    "export_batches": (_exported, "SELECT (row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1) // 50 AS batch, conv_id * 1000 + turn AS uid FROM conversations"),
    "table_numbered": (_numbered, "SELECT event_id AS uid, row_number() OVER (ORDER BY value, event_id) - 1 AS number FROM events"),
    "graph_add_nodes": (_added, "SELECT n_nationkey AS uid, n_name AS kind FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region"),
}
