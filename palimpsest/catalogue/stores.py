"""Vector index, table store, SQLite source, and time stamps of locales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import timestamps
from palimpsest.operators import search
from palimpsest.operators import tables as T
from palimpsest.session import fresh_path, read
from palimpsest.sources import sqlite
from palimpsest.sources.store import KeptCounts, Sessions, TableStore
from palimpsest.sources.vector_index import VectorIndex, filtered_search

from .common import HISTORY_SQL, episodes, history, vector_queries, vectors
from .vectors import SCORES
from .vectors import _sql as knn_sql


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "uid", F.round("score", 6).alias("score"))


def _index(spark, sf, df: DataFrame | None = None) -> VectorIndex:
    return VectorIndex.create(vectors(spark, sf) if df is None else df, fresh_path(spark, "index"))


def _index_search(spark, sf):
    """All lists are looked into, so that the result is the exact one; codes choose, vectors decide."""
    index = _index(spark, sf)
    return _ranked(index.search(vector_queries(spark, sf), 5, probes=len(index.centroids)))


def _index_recall(spark, sf):
    """Of the index as it sets itself up: neighbours that it finds, and that there are, by label of the query."""
    index, queries = _index(spark, sf), vector_queries(spark, sf)
    found = index.search(queries, 10).select("query_id", "uid", F.lit(1).alias("hit"))
    exact = search.knn(queries, vectors(spark, sf), 10).select("query_id", "uid")
    return exact.join(found, ["query_id", "uid"], "left").groupBy((F.col("query_id") / 20 % 10).cast("int").alias("part")).agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


def _index_removed(spark, sf):
    """Two additions, removals before and after, one vector added again with another's numbers; saved, opened, compacted."""
    df = vectors(spark, sf)
    index = _index(spark, sf, df.where("uid % 2 = 0"))
    index.add(df.where("uid % 2 = 1"))
    index.remove(df.where("uid % 3 = 0").select("uid"))
    moved = df.where("uid % 12 = 1").select((F.col("uid") - 1).alias("uid"), "embedding", "label")
    index.add(moved)
    index.remove(df.where("uid % 5 = 4").select("uid").union(df.select((F.col("uid") + 1000000).alias("uid"))))
    index = index.save(fresh_path(spark, "saved"))
    index.compact()
    return _ranked(index.search(vector_queries(spark, sf), 5, probes=len(index.centroids)))


REMOVED_SQL = f"""
WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 4 UNION ALL SELECT vec_id - 1, embedding FROM embeddings WHERE vec_id % 12 = 1 AND (vec_id - 1) % 5 <> 4),
x AS (SELECT q.vec_id AS query_id, c.vec_id AS uid, {SCORES['cosine']} AS s FROM embeddings q, c WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, uid) AS INTEGER) AS rank, uid, round(s, 6) AS score FROM x QUALIFY rank <= 5
"""


def _index_fallback(spark, sf):
    """Four times ten hits, of which those of three labels stay; queries with fewer than five are answered by the exact search."""
    index = _index(spark, sf)
    found = filtered_search(index, vector_queries(spark, sf), F.col("label").isin(0, 3, 7), 10, probes=len(index.centroids))
    return found.select("query_id", "rank", "uid", F.round("score", 6).alias("score"), "exact")


FALLBACK_SQL = f"""
WITH x AS (SELECT q.vec_id AS query_id, c.vec_id AS uid, c.label IN (0, 3, 7) AS fit, {SCORES['cosine']} AS s FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, uid) AS place FROM x), few AS (SELECT query_id, count(*) FILTER (fit AND place <= 40) < 5 AS exact FROM n GROUP BY 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, uid) AS INTEGER) AS rank, uid, round(s, 6) AS score, exact FROM n JOIN few USING (query_id) WHERE fit AND (exact OR place <= 40) QUALIFY rank <= 10
"""


def _event_store(spark, sf) -> TableStore:
    """Events as episodes in three parts, and citations of them."""
    store, df = TableStore(spark, fresh_path(spark, "store")), episodes(spark, sf).select("uid", "session_key", "value")
    for k in range(3):
        store.append("episodes", df.where(F.col("uid") % 3 == k))
        store.append("citations", df.where(F.col("uid") % 3 == k).select(F.col("uid").alias("episode"), F.concat(F.lit("f"), F.col("uid") % 7).alias("feature")))
    return store


def _drained(spark, sf):
    """A fifth of the sessions is deleted, some keys at a time; the run that begins stops after two batches, another one ends it."""
    store = _event_store(spark, sf)
    users = episodes(spark, sf).select("session_key").distinct()
    rows = users.select(F.col("session_key").cast("string").alias("session_key"), F.current_timestamp().alias("created_at"), *[F.lit("").alias(c) for c in ("configuration", "description", "metadata")], F.when(F.col("session_key") % 5 == 0, "deleted").otherwise("active").alias("status"))
    store.append("sessions", rows)
    size = max(1, episodes(spark, sf).where("session_key % 5 = 0").count() // 4)
    Sessions(store).drain("episodes", "uid", {"citations": "episode"}, size, most=2)
    Sessions(TableStore(spark, store.root)).drain("episodes", "uid", {"citations": "episode"}, size)
    left = store.read("episodes").select(F.lit("episode").alias("kind"), F.col("uid").cast("string").alias("what"))
    cited = store.read("citations").select(F.lit("citation"), F.concat_ws(":", "episode", "feature"))
    return left.union(cited).union(store.read("sessions").select(F.lit("session"), "session_key"))


DRAINED_SQL = """
SELECT 'episode' AS kind, CAST(event_id AS VARCHAR) AS what FROM events WHERE user_id % 5 <> 0 UNION ALL SELECT 'citation', event_id || ':f' || event_id % 7 FROM events WHERE user_id % 5 <> 0
UNION ALL SELECT 'session', CAST(user_id AS VARCHAR) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 <> 0
"""


def _counted(spark, sf):
    """Counts kept while parts come, two sessions are deleted, and rows of one of them come again."""
    store = _event_store(spark, sf)
    counts = KeptCounts(store, "episodes", "session_key")
    counts.refresh()
    df = episodes(spark, sf).select("uid", "session_key", "value")
    store.delete("episodes", df.where("session_key IN (1, 2)").select("session_key"), "session_key")
    store.append("episodes", df.where("session_key = 2 AND uid % 2 = 0"))
    return counts.read()


COUNTED_SQL = "SELECT user_id AS session_key, count(*) AS n FROM events WHERE user_id NOT IN (1, 2) OR (user_id = 2 AND event_id % 2 = 0) GROUP BY 1"

#: Tables that hold set ids.
SET_TABLES = ("features", "history", "citations", "categories", "configs", "clusters")


def _migrated(spark, sf):
    """Old set ids of six tables get new names in one commit, after a look for collisions."""
    store, h = TableStore(spark, fresh_path(spark, "store")), history(spark, sf)
    for k, name in enumerate(SET_TABLES):
        store.write(name, h.where(F.col("history_id").cast("long") % (k + 2) == 0).select("set_id", F.col("history_id").alias("what")))
    mapping = h.select("set_id").distinct().where("set_id LIKE '%1'").select("set_id", F.concat(F.lit("mem_"), "set_id"))
    for name in SET_TABLES:
        if not T.collisions(store.read(name), mapping, "set_id").isEmpty():
            raise ValueError(f"{name} has new ids already")
    store.change_all({name: lambda df: T.rewrite_keys(df, mapping, "set_id") for name in SET_TABLES})
    parts = [store.read(name).groupBy("set_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "set_id", "n") for name in SET_TABLES]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


MIGRATED_SQL = " UNION ALL ".join(f"SELECT '{name}' AS name, CASE WHEN set_id LIKE '%1' THEN 'mem_' || set_id ELSE set_id END AS set_id, count(*) AS n FROM ({HISTORY_SQL}) WHERE CAST(history_id AS BIGINT) % {k + 2} = 0 GROUP BY 2" for k, name in enumerate(SET_TABLES))


def _appended(spark, sf):
    """Episodes that come in parts, one of them twice with the same ids: an upsert keeps each once."""
    store = _event_store(spark, sf)
    store.append("episodes", store.read("episodes").where("uid % 10 = 0"))
    return store.change("episodes", lambda df: df.dropDuplicates(["uid"])).select("uid", "session_key")


def _sqlite(spark, sf):
    """Episodes in SQLite files; a filter text goes into the source."""
    path = fresh_path(spark, "sqlite")
    sqlite.write_table(read(spark, sf, "events").select("event_id", "user_id", "event_type", "value").repartition(4, "event_id"), path, "events", "event_id")
    return sqlite.read_table(spark, path, "events", "event_id", "event_type IN (click, purchase) AND value > 20.5 AND user_id < 40", page=1000)


ZONES = {"UTC": 0, "Asia/Tokyo": 9}
LENGTHS = ("short", "medium", "long", "full")
LOCALES = ("en_US", "de_DE", "fr_FR")


def _stamps(spark, sf):
    """Order dates, with a second of the day by the key, in four lengths, three locales and two zones; without styles empty."""
    df = read(spark, sf, "orders").select("o_orderkey", F.timestamp_seconds(F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400 + F.col("o_orderkey") % 86400).alias("at"))
    found = [timestamps.formatted(spark, F.col("at"), s, s, w, z).alias(f"{s}_{w}_{k}") for s in LENGTHS for w in LOCALES for k, z in enumerate(ZONES)]
    return df.select("o_orderkey", *found, timestamps.formatted(spark, F.col("at"), None, None, "de_DE").alias("without"))


MONTHS = {
    "en_US": "January February March April May June July August September October November December".split(),
    "de_DE": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr_FR": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
}
SHORT_MONTHS = {"en_US": [m[:3] for m in MONTHS["en_US"]], "fr_FR": "janv. févr. mars avr. mai juin juil. août sept. oct. nov. déc.".split()}
DAYS = {
    "en_US": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
    "de_DE": "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag".split(),
    "fr_FR": "lundi mardi mercredi jeudi vendredi samedi dimanche".split(),
}
ZONE_NAMES = {"en_US": ("Coordinated Universal Time", "Japan Standard Time"), "de_DE": ("Koordinierte Weltzeit", "Japanische Normalzeit"), "fr_FR": ("Temps universel coordonné", "heure normale du Japon")}


def _stamp_sql(style: str, where: str, k: int) -> str:
    """A stamp by plain formatting of the wall time w0 or w1."""
    w, pick = f"w{k}", lambda names, n: f"(['{"', '".join(names)}'])[{n}]"
    month, day = pick(MONTHS[where], f"month({w})"), pick(DAYS[where], f"isodow({w})")
    d, y, zone = f"day({w})", f"year({w})", {"long": f"' {('UTC', 'JST')[k]}'", "full": f"' {ZONE_NAMES[where][k]}'"}.get(style)
    if where == "en_US":
        date = {"short": f"month({w}) || '/' || {d} || '/' || strftime({w}, '%y')", "medium": f"{pick(SHORT_MONTHS[where], f'month({w})')} || ' ' || {d} || ', ' || {y}"}.get(style, f"{month} || ' ' || {d} || ', ' || {y}")
        time, joined = f"((hour({w}) + 11) % 12 + 1) || strftime({w}, ':%M{'' if style == 'short' else ':%S'} %p')", "' at '" if zone else "', '"
        date = f"{day} || ', ' || {date}" if style == "full" else date
    else:
        time = f"strftime({w}, '%H:%M{'' if style == 'short' else ':%S'}')"
        if where == "de_DE":
            date = {"short": f"strftime({w}, '%d.%m.%y')", "medium": f"strftime({w}, '%d.%m.%Y')"}.get(style, f"{d} || '. ' || {month} || ' ' || {y}")
            date, joined = (f"{day} || ', ' || {date}" if style == "full" else date), "' um '" if zone else "', '"
        else:
            date = {"short": f"strftime({w}, '%d/%m/%Y')", "medium": f"{d} || ' ' || {pick(SHORT_MONTHS[where], f'month({w})')} || ' ' || {y}"}.get(style, f"{d} || ' ' || {month} || ' ' || {y}")
            date, joined = (f"{day} || ' ' || {date}" if style == "full" else date), "' à '" if zone else "' '" if style == "short" else "', '"
    return f"{date} || {joined} || {time}" + (f" || {zone}" if zone else "")


STAMPS_SQL = (
    "WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS w0, w0 + INTERVAL 9 HOUR AS w1 FROM orders) SELECT o_orderkey, "
    + ", ".join(f"{_stamp_sql(s, w, k)} AS {s}_{w}_{k}" for s in LENGTHS for w in LOCALES for k in range(2))
    + ", '' AS without FROM t"
)

QUERIES = {
    "vec_index_search": (_index_search, knn_sql("cosine", 5)),
    "vec_index_recall": (_index_recall, None),
    "vec_index_removed": (_index_removed, REMOVED_SQL),
    "vec_index_fallback": (_index_fallback, FALLBACK_SQL),
    "store_delete_drain": (_drained, DRAINED_SQL),
    "store_kept_counts": (_counted, COUNTED_SQL),
    "store_append": (_appended, "SELECT event_id AS uid, user_id AS session_key FROM events"),
    "migrate_sets": (_migrated, MIGRATED_SQL),
    "source_sqlite_filtered": (_sqlite, "SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase') AND value > 20.5 AND user_id < 40"),
    "text_timestamps": (_stamps, STAMPS_SQL),
}
