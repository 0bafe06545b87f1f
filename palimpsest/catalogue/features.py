"""Feature store, history queue, sets and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.ids import set_id
from palimpsest.operators import features as P
from palimpsest.operators import sets as C
from palimpsest.operators import tables as T
from palimpsest.session import read

from .common import FEATURES_SQL, HISTORY_SQL, episodes, features, history


def _list(spark, sf):
    return P.feature_page(features(spark, sf).where("tag = 'click'"), 60, 2).select("id", "feature")


def _threshold(spark, sf):
    return P.feature_page(features(spark, sf), 40, 1, tag_threshold=8).select("id", "tag")


def _citations(spark, sf):
    found = features(spark, sf)
    cited = found.where("id % 3 = 0").select(F.col("id").alias("feature_id"), F.concat(F.lit("h"), F.col("id") % 11).alias("history_id")).union(found.where("id % 6 = 0").select("id", F.lit("h99")))
    return T.with_rows_of(found.select("id"), cited, "id", "feature_id", "history_id", "citations").select("id", F.concat_ws(",", "citations").alias("citations"))


def _group(spark, sf):
    return P.grouped(features(spark, sf), ["category", "tag", "feature"]).select("category", "tag", "feature", "n", F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"))


def _profile(spark, sf):
    return P.profile(features(spark, sf), ["set_id"], ["created_at", "id"]).select("set_id", "tag", "feature", F.col("value").cast("double").alias("value"))


def _sections(spark, sf):
    return P.sections(features(spark, sf), ["set_id", "category", "tag"], 15).select("set_id", "category", "tag", "n", "items")


def _merged(spark, sf):
    found = features(spark, sf)
    cited = found.select(F.col("id").alias("feature_id"), F.concat(F.lit("h"), F.col("id") % 7).alias("history_id"))
    return P.merged_citations(found, cited, ["tag", "feature"]).select("tag", "feature", F.concat_ws(",", "citations").alias("citations"))


def _pending(spark, sf):
    return P.pending_sets(history(spark, sf), 25)


def _dirty(spark, sf):
    return P.dirty_sets(history(spark, sf), 30, F.to_timestamp(F.lit("2024-01-02 00:00:00")))


def _purge(spark, sf):
    return P.purgeable(history(spark, sf)).select("set_id", "history_id")


def _prefix(spark, sf):
    return P.sets_with_prefix(history(spark, sf), features(spark, sf), "user_1")


def _history_page(spark, sf):
    return history(spark, sf).where("set_id = 'user_7' AND NOT ingested").orderBy("history_id").limit(5).select("history_id")


def _mark(spark, sf):
    h = history(spark, sf)
    return P.mark_ingested(h, h.where("set_id LIKE 'user_2%'")).groupBy("ingested").agg(F.count("*").alias("n"))


def _update(spark, sf):
    old = features(spark, sf).select("id", "tag", "feature")
    changes = old.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.lit("new")).alias("tag"), F.lit(None).cast("string").alias("feature"))
    return T.patch(old, changes, "id", ["tag", "feature"])


def _rewrite(spark, sf):
    h = history(spark, sf)
    mapping = h.where("set_id LIKE 'user_1%'").select("set_id", F.concat(F.lit("mem_"), F.col("set_id")).alias("new")).distinct()
    return T.rewrite_keys(h, mapping, "set_id").groupBy("set_id").agg(F.count("*").alias("n"))


def _commands(spark, sf):
    """Events as a command log: errors delete what their user has under the same key."""
    log = episodes(spark, sf).select(F.col("uid").alias("seq"), F.when(F.col("producer_role") == "error", "delete").otherwise("add").alias("command"), F.col("session_key").alias("set_id"), F.concat(F.lit("k"), F.col("k") % 5).alias("feature"), F.col("value"))
    none = log.select("set_id", "feature", "value").limit(0)
    return P.apply_commands(none, log, ["set_id", "feature"]).select("set_id", "feature", "seq")


def _types(spark, sf):
    entries = episodes(spark, sf).select("uid", F.when(F.col("uid") % 2 == 0, F.array(F.lit("org"), F.lit("user"))).otherwise(F.array(F.lit("org"))).alias("keys"))
    types = spark.createDataFrame([(1, ["org"]), (2, ["org", "user"]), (3, ["project"]), (4, [])], "type_id int, tags array<string>")
    return C.matching_types(entries, types).select("uid", "type_id")


def _set_ids(spark, sf):
    df = read(spark, sf, "customer")
    return df.select("c_custkey", set_id("user", F.col("c_mktsegment"), None, {"user": F.col("c_custkey").cast("string"), "nation": F.col("c_nationkey").cast("string")}).alias("set_id"))


def _config(spark, sf):
    nations, regions = read(spark, sf, "nation"), read(spark, sf, "region")
    own = nations.select(F.col("n_nationkey").alias("set_id"), F.concat(F.lit("cat"), F.col("n_nationkey") % 4).alias("name"))
    inherited = regions.select(F.col("r_regionkey").alias("type_id"), F.explode(F.array(*[F.lit(f"cat{k}") for k in range(3)])).alias("name"))
    links = nations.select(F.col("n_nationkey").alias("set_id"), F.col("n_regionkey").alias("type_id"))
    return own, inherited, links


def _resolve(spark, sf):
    return C.resolve_categories(*_config(spark, sf))


def _category_sets(spark, sf):
    own, inherited, links = _config(spark, sf)
    return C.sets_of_category(inherited, own, links, "cat1")


def _effective(spark, sf):
    own, _, _ = _config(spark, sf)
    defaults = ["cat0", "base"]
    disabled = own.where("set_id % 5 = 0").select("set_id", F.lit("base").alias("name")).union(own.where("set_id % 7 = 0").select("set_id", F.lit("cat0")))
    return C.effective_categories(own, defaults, disabled, own.select("set_id").distinct())


OWN = "SELECT n_nationkey AS set_id, 'cat' || (n_nationkey % 4) AS name FROM nation"
INHERITED = "SELECT n_nationkey AS set_id, c AS name FROM nation, (VALUES ('cat0'), ('cat1'), ('cat2')) v(c)"
SHAKE = "199493c04582"  # shake_256 of "nationuser", six bytes

SECTIONS_SQL = f"""
SELECT set_id, category, tag, count(*) AS n, '[' || string_agg('{{"tag":"' || tag || '","feature":"' || feature || '","value":"' || value || '","metadata":{{"id":' || id || '}}}}', ',' ORDER BY feature, CAST(value AS VARCHAR), id) || ']' AS items
FROM ({FEATURES_SQL}) GROUP BY 1, 2, 3 HAVING count(*) >= 15
"""

QUERIES = {
    "feat_list": (_list, f"SELECT id, feature FROM ({FEATURES_SQL}) WHERE tag = 'click' ORDER BY created_at, id LIMIT 60 OFFSET 120"),
    "feat_page_tag_threshold": (_threshold, f"WITH p AS (SELECT * FROM ({FEATURES_SQL}) ORDER BY created_at, id LIMIT 40 OFFSET 40) SELECT id, tag FROM p QUALIFY count(*) OVER (PARTITION BY tag) >= 8"),
    "feat_citations": (_citations, "WITH c AS (SELECT event_id AS f, 'h' || (event_id % 11) AS h FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'h99' FROM events WHERE event_id % 6 = 0) SELECT event_id AS id, coalesce(string_agg(h, ',' ORDER BY h), '') AS citations FROM events LEFT JOIN c ON f = event_id GROUP BY 1"),
    "feat_group": (_group, f"SELECT category, tag, feature, count(*) AS n, min(id) AS first, max(id) AS last FROM ({FEATURES_SQL}) GROUP BY 1, 2, 3"),
    "feat_profile_pivot": (_profile, f"SELECT set_id, tag, feature, arg_max(value, (created_at, id)) AS value FROM ({FEATURES_SQL}) GROUP BY 1, 2, 3"),
    "feat_sections": (_sections, SECTIONS_SQL),
    "feat_merged_citations": (_merged, f"SELECT tag, feature, string_agg(DISTINCT 'h' || (id % 7), ',' ORDER BY 'h' || (id % 7)) AS citations FROM ({FEATURES_SQL}) GROUP BY 1, 2"),
    "feat_pending_sets": (_pending, f"SELECT set_id FROM ({HISTORY_SQL}) WHERE NOT ingested GROUP BY 1 HAVING count(*) >= 25"),
    "feat_dirty_union": (_dirty, f"SELECT set_id FROM ({HISTORY_SQL}) WHERE NOT ingested GROUP BY 1 HAVING count(*) >= 30 UNION SELECT set_id FROM ({HISTORY_SQL}) WHERE NOT ingested AND created_at <= TIMESTAMP '2024-01-02'"),
    "feat_purge": (_purge, f"WITH h AS ({HISTORY_SQL}) SELECT set_id, history_id FROM h WHERE ingested AND NOT EXISTS (SELECT 1 FROM h o WHERE o.set_id = h.set_id AND NOT o.ingested)"),
    "feat_prefix_union": (_prefix, f"SELECT set_id FROM ({HISTORY_SQL}) WHERE starts_with(set_id, 'user_1') UNION SELECT set_id FROM ({FEATURES_SQL}) WHERE starts_with(set_id, 'user_1')"),
    "feat_history_page": (_history_page, f"SELECT history_id FROM ({HISTORY_SQL}) WHERE set_id = 'user_7' AND NOT ingested ORDER BY history_id LIMIT 5"),
    "feat_mark_ingested": (_mark, f"SELECT ingested OR set_id LIKE 'user_2%' AS ingested, count(*) AS n FROM ({HISTORY_SQL}) GROUP BY 1"),
    "feat_update": (_update, f"SELECT id, CASE WHEN id % 8 = 0 THEN 'new' ELSE tag END AS tag, feature FROM ({FEATURES_SQL})"),
    "feat_rewrite_sets": (_rewrite, f"SELECT CASE WHEN set_id LIKE 'user_1%' THEN 'mem_' || set_id ELSE set_id END AS set_id, count(*) AS n FROM ({HISTORY_SQL}) GROUP BY 1"),
    "feat_commands": (_commands, "WITH l AS (SELECT event_id AS seq, event_type, user_id AS set_id, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS feature FROM events) SELECT set_id, feature, seq FROM l WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM l d WHERE d.event_type = 'error' AND d.set_id = l.set_id AND d.feature = l.feature AND d.seq > l.seq)"),
    "set_type_match": (_types, "SELECT event_id AS uid, t AS type_id FROM events, (VALUES (1), (2), (4)) v(t) WHERE t <> 2 OR event_id % 2 = 0"),
    "set_ids": (_set_ids, f"SELECT c_custkey, 'mem_user_org_' || c_mktsegment || '_2_{SHAKE}__nation_' || c_nationkey || '_user_' || c_custkey AS set_id FROM customer"),
    "config_resolve": (_resolve, f"SELECT set_id, name, 'own' AS source FROM ({OWN}) UNION ALL (SELECT set_id, name, 'inherited' FROM ({INHERITED}) EXCEPT SELECT set_id, name, 'inherited' FROM ({OWN}))"),
    "category_sets": (_category_sets, "SELECT n_nationkey AS set_id FROM nation WHERE n_nationkey % 4 <> 1"),
    "config_effective": (_effective, f"{OWN} UNION ALL SELECT n_nationkey, v.c FROM nation, (VALUES ('cat0'), ('base')) v(c) WHERE NOT (v.c = 'base' AND n_nationkey % 5 = 0) AND NOT (v.c = 'cat0' AND n_nationkey % 7 = 0) AND NOT (v.c = 'cat0' AND n_nationkey % 4 = 0)"),
}
