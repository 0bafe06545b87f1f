"""Configuration of sets, the history queue, consolidation, and functions on single values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import ids as I
from palimpsest.functions import properties as O
from palimpsest.functions import text as X
from palimpsest.operators import context as N
from palimpsest.operators import features as P
from palimpsest.operators import memory as M
from palimpsest.operators import sets as C
from palimpsest.session import read

from .common import FEATURES_SQL, HISTORY_SQL, episodes, features, history, messages, typed_episodes


def _categories(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Regions as categories, nations as their tags."""
    categories = read(spark, sf, "region").select(F.concat(F.lit("c"), "r_regionkey").alias("id"), F.lit("set0").alias("set_id"), F.col("r_name").alias("name"))
    tags = read(spark, sf, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("id"), F.concat(F.lit("c"), "n_regionkey").alias("category_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("description"))
    return categories, tags


CATEGORIES = "c AS (SELECT 'c' || r_regionkey AS id, 'set0' AS set_id, r_name AS name FROM region), t AS (SELECT 't' || n_nationkey AS id, 'c' || n_regionkey AS category_id, n_name AS name, lower(n_name) AS description FROM nation)"


def _with_tags(spark, sf):
    categories, tags = _categories(spark, sf)
    found = C.with_tags(categories, tags.where("category_id <> 'c4'"))
    return found.select("id", F.concat_ws(",", F.transform("tags", lambda t: F.concat_ws("=", t["name"], t["description"]))).alias("tags"))


def _cloned(spark, sf):
    """Two categories cloned into another set, and one deleted with its tags."""
    categories, tags = _categories(spark, sf)
    pairs = categories.where("id IN ('c1', 'c3')").select("id", F.concat(F.lit("copy-"), "id").alias("new_id"), F.lit("set1").alias("set_id"))
    categories, tags = C.cloned(categories, tags, pairs)
    categories, tags = C.delete_category(categories, tags, categories.where("id = 'c2'").select("id"))
    return categories.select("id", "set_id", "name").union(tags.select("id", "category_id", "name"))


CLONED_SQL = (
    f"WITH {CATEGORIES}, p AS (SELECT id, 'copy-' || id AS new_id FROM c WHERE id IN ('c1', 'c3')) SELECT id, set_id, name FROM c WHERE id <> 'c2' UNION ALL SELECT new_id, 'set1', name FROM c JOIN p USING (id) "
    "UNION ALL SELECT id, category_id, name FROM t WHERE category_id <> 'c2' UNION ALL SELECT new_id || '/' || t.id, new_id, name FROM t JOIN p ON p.id = category_id"
)


def _set_config(spark, sf):
    old = read(spark, sf, "customer").select(F.col("c_custkey").alias("set_id"), F.col("c_mktsegment").alias("config"))
    return C.set_config(old.where("set_id % 3 <> 0"), old.where("set_id % 2 = 0").select("set_id", F.lit("new").alias("config")))


def _register(spark, sf):
    """Of two registrations of a set's type the first stays, a disabled name stands once."""
    given = read(spark, sf, "customer").select(F.col("c_custkey").alias("set_id"), F.col("c_nationkey").alias("type_id"))
    links = C.register_type(given.where("set_id % 2 = 0"), given.select("set_id", (F.col("type_id") + 100).alias("type_id")))
    off = given.select("set_id", F.concat(F.lit("n"), F.col("type_id") % 3).alias("name"))
    return links.select("set_id", F.col("type_id").cast("string").alias("what")).union(C.disable(off.where("set_id % 5 = 0"), off))


def _types(spark, sf):
    given = read(spark, sf, "nation").select(F.col("n_nationkey").alias("type_id"), (F.col("n_regionkey") % 2).alias("org_id"), F.array(F.lit("org"), F.concat(F.lit("r"), "n_regionkey")).alias("tags"))
    again = given.select((F.col("type_id") + 100).alias("type_id"), "org_id", F.reverse("tags").alias("tags"))
    return C.add_types(given.where("type_id % 5 <> 0"), again).select("type_id")


def _all_sets(spark, sf):
    df = episodes(spark, sf).select("uid", F.col("session_key").cast("string").alias("user"))
    matched = df.where("uid % 3 = 0").select("uid", F.concat(F.lit("set_"), "user").alias("set_id")).union(df.where("uid % 9 = 0").select("uid", F.lit("org")))
    return C.all_sets(matched, df, [F.lit("org"), F.when(F.col("uid") % 2 == 0, F.concat(F.lit("user_"), "user"))])


def _common(spark, sf):
    sets = history(spark, sf).select("set_id")
    return C.common_sets([sets.where("set_id LIKE '%1%'"), sets.where("set_id LIKE '%2'"), sets])


def _history_counts(spark, sf):
    h = history(spark, sf)
    few = h.where("set_id LIKE 'user_1%'").select("set_id")
    counts = [P.history_count(h), P.history_count(h, few), P.history_count(h, few, False), P.history_count(h, None, True)]
    whole = [c.withColumn("kind", F.lit(k)) for k, c in enumerate(counts)]
    return whole[0].union(whole[1]).union(whole[2]).union(whole[3])


def _queue(spark, sf):
    """Rows are added, those of some history ids and sets deleted; the next batch of what is pending."""
    h = history(spark, sf)
    new = h.select("set_id", F.concat(F.lit("n"), "history_id").alias("history_id"), "created_at").where("history_id LIKE '%7'")
    cited = features(spark, sf).select(F.col("id").alias("feature_id"), F.col("id").cast("string").alias("history_id"))
    left, kept = P.delete_history(P.add_history(h, new.union(new)), P.add_citations(cited, cited), h.where("history_id LIKE '%3'").select("history_id"))
    left = P.delete_history_sets(left, left.where("set_id LIKE '%9'").select("set_id"))
    batch = P.next_batch(left, left.select("set_id"), 5)
    known, missing = P.known_and_missing(batch, episodes(spark, sf).select(F.col("uid").cast("string").alias("uid"), "value"))
    return known.select("history_id", F.lit("known").alias("what")).union(missing.select("history_id", F.lit("missing"))).union(kept.select("history_id", F.lit("cited")))


QUEUE_SQL = f"""
WITH h AS ({HISTORY_SQL}), a AS (SELECT set_id, history_id, ingested FROM h UNION ALL SELECT DISTINCT set_id, 'n' || history_id, false FROM h WHERE history_id LIKE '%7'),
l AS (SELECT * FROM a WHERE history_id NOT IN (SELECT history_id FROM h WHERE history_id LIKE '%3') AND set_id NOT LIKE '%9'),
b AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY history_id) AS p FROM l WHERE NOT ingested QUALIFY p <= 5)
SELECT history_id, CASE WHEN history_id LIKE 'n%' THEN 'missing' ELSE 'known' END AS what FROM b UNION ALL SELECT CAST(event_id AS VARCHAR), 'cited' FROM events WHERE CAST(event_id AS VARCHAR) NOT LIKE '%3'
"""


def _consolidated(spark, sf):
    """Of each (set, tag) with a reply the least feature is kept; one merged feature cites what the others did. Sets that end in 1 have no reply, in 2 one that failed."""
    f = features(spark, sf).select("id", "set_id", "tag", "feature", "value").withColumn("id", F.col("id").cast("string"))
    cited = f.select(F.col("id").alias("feature_id"), F.concat(F.lit("h"), F.col("id").cast("long") % 7).alias("history_id"))
    merged = F.array(F.struct(F.concat_ws("-", F.lit("m"), "set_id", "tag").alias("id"), F.lit("all").alias("feature"), F.lit("x").alias("value")))
    replies = f.where("set_id NOT LIKE '%1'").groupBy("set_id", "tag").agg(F.min("id").alias("least"))
    replies = replies.select("set_id", "tag", F.when(~F.col("set_id").like("%2"), F.array("least")).alias("keep"), merged.alias("merged"))
    left, kept = P.consolidated(f, cited, replies, ["set_id", "tag"])
    lists = kept.groupBy("feature_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("history_id"))).alias("citations"))
    return left.join(lists, F.col("id") == F.col("feature_id"), "left").select("id", "set_id", "tag", "feature", "citations")


CONSOLIDATED_SQL = """
WITH f AS (SELECT CAST(event_id AS VARCHAR) AS id, 'user_' || user_id AS set_id, event_type AS tag, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS feature, 'h' || (event_id % 7) AS cited FROM events),
g AS (SELECT *, min(id) OVER (PARTITION BY set_id, tag) AS least FROM f), d AS (SELECT * FROM g WHERE set_id NOT LIKE '%1' AND set_id NOT LIKE '%2' AND id <> least)
SELECT id, set_id, tag, feature, cited AS citations FROM g WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'm-' || set_id || '-' || tag, set_id, tag, 'all', (SELECT string_agg(DISTINCT d.cited, ',' ORDER BY d.cited) FROM d WHERE d.set_id = r.set_id AND d.tag = r.tag) FROM (SELECT DISTINCT set_id, tag FROM f WHERE set_id NOT LIKE '%1' AND set_id NOT LIKE '%2') r
"""


def _summarised(spark, sf):
    """Sessions over 1,000 characters hand what is over to a summary: the number of its texts, after the old one."""
    df = messages(spark, sf)
    old = df.where("session_key % 2 = 0").select("session_key").distinct().withColumn("summary", F.lit("old"))
    left, summaries = M.summarise(df, "session_key", ["sequence_num"], old, lambda before, texts: f"{before}+{len(texts)}", 1000)
    return left.select("session_key", F.col("uid").cast("string").alias("what")).union(summaries.select("session_key", "summary"))


SUMMARISED_SQL = """
WITH m AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS chars FROM conversations), o AS (SELECT conv_id, count(*) AS n FROM m WHERE chars > 1000 GROUP BY 1),
s AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id AS session_key, CAST(conv_id * 1000 + turn AS VARCHAR) AS what FROM m WHERE chars <= 1000
UNION ALL SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'old' ELSE '' END || coalesce('+' || n, '') FROM s LEFT JOIN o USING (conv_id) WHERE n IS NOT NULL OR conv_id % 2 = 0
"""


def _lengths(spark, sf):
    return M.content_length(messages(spark, sf), "session_key")


def _order(spark, sf):
    """Events by time of day, two events each, blocks and pieces counted down."""
    df = episodes(spark, sf).select("session_key", "uid", F.to_date("created_at").alias("ts"), (F.col("uid") % 2).alias("event_uid"), (F.lit(3) - F.col("uid") % 3).alias("index"), (-F.col("uid")).alias("offset"))
    return M.segment_order(df, ["session_key"]).select("uid", "position")


def _continues(spark, sf):
    df = episodes(spark, sf).select("uid", "session_key", "created_at", F.floor(F.col("uid") / 3).alias("event_uid"), (F.floor(F.col("uid") / 2) % 2).alias("index"))
    return df.select("uid", N.continues("event_uid", "index", ["session_key"], ["uid"]).alias("continues"))


def _encoded(spark, sf):
    """Typed properties to their JSON and back: nothing is lost."""
    df = typed_episodes(spark, sf).select("uid", "properties", O.decode(O.encode(F.col("properties"))).alias("back"))
    same = lambda k: F.col("properties")[k].eqNullSafe(F.col("back")[k])
    return df.select("uid", F.array_join(F.array_sort(F.map_keys("back")), ",").alias("keys"), (same("k") & same("value") & same("type") & same("even") & same("at")).alias("same"), F.col("back")["value"]["f"].alias("value"))


ENCODED_SQL = "SELECT event_id AS uid, CASE WHEN event_id % 3 <> 0 THEN 'at,even,k,type' ELSE 'at,k,type' END || CASE WHEN value < 100 THEN ',value' ELSE '' END AS keys, true AS same, CASE WHEN value < 100 THEN value END AS value FROM events"


def _seconds(spark, sf):
    df = episodes(spark, sf)
    return df.select("uid", X.seconds(F.when(F.col("uid") % 2 == 0, F.unix_millis("created_at")).otherwise(F.unix_seconds("created_at"))).alias("seconds"))


def _hashes(spark, sf):
    df = read(spark, sf, "nation")
    lists = df.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return lists.select("n_regionkey", I.input_hash(F.col("names")).alias("input"), I.child_id(F.col("names")[0], F.lit(2)).alias("child"))


def _uuids(spark, sf):
    """Version, variant and length of ids by name, and that names that differ give ids that differ."""
    df = read(spark, sf, "customer").select("c_custkey", I.uuid5(F.col("c_name"), uuid.NAMESPACE_URL).alias("id"))
    return df.select("c_custkey", F.length("id").alias("length"), F.substring("id", 15, 1).alias("version"), F.count("*").over(M.W.partitionBy("id")).alias("same"))


def _cleaned(spark, sf):
    df = messages(spark, sf)
    return df.select("uid", F.sha2(X.without_nul(F.concat("content", F.lit("\0x\0"))), 256).alias("hash"))


def _tails(spark, sf):
    return messages(spark, sf).select("uid", F.sha2(X.tail(F.col("content"), 20), 256).alias("hash"), F.sha2(F.array_join(X.halves(F.col("content")), "|"), 256).alias("halves"), X.word_budget(F.length("content") * 100).alias("words"))


TAIL_SQL = """
WITH c AS (SELECT *, right(text, 80) AS cut FROM conversations) SELECT conv_id * 1000 + turn AS uid, sha256(CASE WHEN length(text) <= 80 THEN text WHEN contains(cut, chr(10)) THEN substring(cut, strpos(cut, chr(10)) + 1) ELSE cut END) AS hash,
sha256(left(text, length(text) // 2) || '|' || substring(text, length(text) // 2 + 1)) AS halves, CAST(ceil(floor(length(text) * 100 / 2.0 / 8) / 100) * 100 AS INTEGER) AS words FROM c
"""


def _metadata(spark, sf):
    """Scalars of the metadata as text, and whether it holds a wanted pair."""
    df = episodes(spark, sf).withColumn("metadata", F.concat(F.lit('{"list": [1], "object": {"a": 1}, "none": null, "k": "'), F.col("k").cast("string"), F.lit('"}')))
    return df.select("uid", O.contains(F.col("metadata"), {"k": "7"}).alias("holds"), F.to_json(O.scalars_only(F.col("metadata"))).alias("scalars"), F.size(O.stringified(F.col("metadata"))).alias("kept"))


def _ids(spark, sf):
    df = episodes(spark, sf)
    given = F.array(F.concat(F.lit(" "), "uid", F.lit(" ")), F.lit(""), F.col("session_key").cast("string"))
    return df.select("uid", F.concat_ws(",", X.some_ids(given, F.array(F.col("uid").cast("string")))).alias("ids"))


def _replies(spark, sf):
    """The last object of a reply, and its lines."""
    last = F.udf(X.last_object, "string")
    reply = F.concat(F.lit('a {"x": "}"} \n\n then {"y": {"z": "}'), "uid", F.lit('"}}\n and {no end'))
    return episodes(spark, sf).select("uid", last(reply).alias("found"), F.size(X.reply_lines(reply)).alias("lines"))


def _word_chunks(spark, sf):
    """Chunks at spaces join to the text but for white space."""
    df = messages(spark, sf).select("uid", "content", F.udf(lambda t: X.word_chunks(t, 200), "array<string>")("content").alias("s"))
    return df.select("uid", F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))) <= 200, F.lit(True)).alias("fits"), F.sha2(F.regexp_replace(F.array_join("s", ""), r"\s+", ""), 256).alias("joined"))


QUERIES = {
    "category_tags": (_with_tags, f"WITH {CATEGORIES} SELECT c.id, coalesce(string_agg(t.name || '=' || description, ',' ORDER BY t.name), '') AS tags FROM c LEFT JOIN t ON category_id = c.id AND category_id <> 'c4' GROUP BY 1"),
    "category_clone": (_cloned, CLONED_SQL),
    "config_upsert": (_set_config, "SELECT c_custkey AS set_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS config FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"),
    "config_insert_missing": (_register, "SELECT c_custkey AS set_id, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE c_nationkey + 100 END AS VARCHAR) AS what FROM customer UNION ALL SELECT c_custkey, 'n' || (c_nationkey % 3) FROM customer"),
    "set_type_add": (_types, "WITH g AS (SELECT n_nationkey AS id, n_regionkey AS r FROM nation) SELECT id AS type_id FROM g WHERE id % 5 <> 0 UNION ALL SELECT id + 100 FROM g WHERE r NOT IN (SELECT r FROM g WHERE id % 5 <> 0)"),
    "set_defaults": (_all_sets, "SELECT event_id AS uid, 'set_' || user_id AS set_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'org' FROM events UNION ALL SELECT event_id, 'user_' || user_id FROM events WHERE event_id % 2 = 0"),
    "set_intersect": (_common, f"SELECT DISTINCT set_id FROM ({HISTORY_SQL}) WHERE set_id LIKE '%1%' AND set_id LIKE '%2'"),
    "feat_history_counts": (_history_counts, f"WITH h AS ({HISTORY_SQL}) SELECT count(*) AS n, 0 AS kind FROM h UNION ALL SELECT count(*), 1 FROM h WHERE set_id LIKE 'user_1%' UNION ALL SELECT count(*), 2 FROM h WHERE set_id LIKE 'user_1%' AND NOT ingested UNION ALL SELECT count(*), 3 FROM h WHERE ingested"),
    "feat_history_queue": (_queue, QUEUE_SQL),
    "feat_consolidate": (_consolidated, CONSOLIDATED_SQL),
    "stm_summarise": (_summarised, SUMMARISED_SQL),
    "stm_length": (_lengths, "SELECT conv_id AS session_key, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1"),
    "segment_order": (_order, "SELECT event_id AS uid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id % 2, 3 - event_id % 3, -event_id) AS INTEGER) AS position FROM events"),
    "ctx_continues": (_continues, "SELECT event_id AS uid, coalesce(lag(event_id // 3) OVER w = event_id // 3 AND lag(event_id // 2 % 2) OVER w = event_id // 2 % 2, false) AS continues FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "value_typed_round_trip": (_encoded, ENCODED_SQL),
    "value_metadata": (_metadata, """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id AS uid, k = '7' AS holds, '{"k":"' || k || '"}' AS scalars, 3 AS kept FROM e"""),
    "value_seconds": (_seconds, "SELECT event_id AS uid, CASE WHEN event_id % 2 = 0 THEN floor(epoch_us(ts) / 1000.0) / 1000.0 ELSE floor(epoch(ts)) END AS seconds FROM events"),
    "value_hashes": (_hashes, "SELECT n_regionkey, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS input, substring(sha256(min(n_name) || ':2'), 1, 16) AS child FROM nation GROUP BY 1"),
    "value_uuid5": (_uuids, "SELECT c_custkey, 36 AS length, '5' AS version, count(*) OVER (PARTITION BY c_name) AS same FROM customer"),
    "value_without_nul": (_cleaned, "SELECT conv_id * 1000 + turn AS uid, sha256(text || 'x') AS hash FROM conversations"),
    "value_tail": (_tails, TAIL_SQL),
    "value_ids": (_ids, "SELECT event_id AS uid, CASE WHEN CAST(event_id AS VARCHAR) = CAST(user_id AS VARCHAR) THEN CAST(event_id AS VARCHAR) WHEN CAST(event_id AS VARCHAR) < CAST(user_id AS VARCHAR) THEN event_id || ',' || user_id ELSE user_id || ',' || event_id END AS ids FROM events"),
    "value_last_object": (_replies, """SELECT event_id AS uid, '{"y": {"z": "}' || event_id || '"}}' AS found, 3 AS lines FROM events"""),
    "text_word_chunks": (_word_chunks, r"SELECT conv_id * 1000 + turn AS uid, true AS fits, sha256(regexp_replace(text, '\s+', '', 'g')) AS joined FROM conversations"),
}
