"""Segments, what is derived from them, and contexts as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import rendering as R
from palimpsest.operators import segments as G
from palimpsest.session import read

from .texts import SENTENCE_SQL


def _events(spark, sf) -> DataFrame:
    """The turns as events: a text block, and an image block after those of users."""
    text = F.struct(F.lit("text").alias("kind"), F.col("text"))
    image = F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"))
    return read(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_uid"), F.col("conv_id").cast("string").alias("partition_key"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"), F.col("role").alias("producer"),
        F.when(F.col("role") == "user", F.array(text, image)).otherwise(F.array(text)).alias("blocks"),
    )


TURNS = "t AS (SELECT conv_id * 1000 + turn AS event_uid, CAST(conv_id AS VARCHAR) AS partition_key, make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS ts, role AS producer, text, turn, conv_id FROM conversations)"
SEGMENTS = f"{TURNS}, s AS (SELECT *, 0 AS index, 'text' AS kind FROM t UNION ALL SELECT * REPLACE (NULL AS text), 1, 'image' FROM t WHERE producer = 'user'), g AS (SELECT *, event_uid || '/' || index AS uid FROM s)"


def _segments(spark, sf) -> DataFrame:
    return G.passed_through(_events(spark, sf)).withColumn("uid", F.concat_ws("/", "event_uid", "index"))


def _links(spark, sf) -> DataFrame:
    """Each segment with one derivative, text ones with two."""
    names = F.when(F.col("kind") == "text", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    rows = _segments(spark, sf).select("partition_key", F.col("uid").alias("segment_uid"), F.explode(names).alias("name"))
    return rows.select("partition_key", F.concat_ws("/", "segment_uid", "name").alias("uid"), "segment_uid")


LINKS = "l AS (SELECT partition_key, uid || '/' || d AS uid, uid AS segment_uid FROM g, (VALUES ('a'), ('b')) v(d) WHERE kind = 'text' OR d = 'a')"


def _passed(spark, sf):
    return _segments(spark, sf).select("uid", "event_uid", "index", "offset", "kind", F.sha2("text", 256).alias("hash"))


def _of_events(spark, sf):
    events = _events(spark, sf).where("event_uid % 3 = 0").select("event_uid")
    return G.of_events(_segments(spark, sf), events.union(events)).select("event_uid", F.concat_ws(",", "segment_uids").alias("segment_uids"))


def _derivatives(spark, sf):
    given = _segments(spark, sf).where("event_uid % 4 = 1").select("uid")
    return G.derivatives_of(_links(spark, sf), given).select("segment_uid", F.concat_ws(",", "derivative_uids").alias("derivative_uids"))


def _appended(spark, sf):
    """Half of the segments are there; all are appended, so that those are not doubled."""
    segments, links = _segments(spark, sf), _links(spark, sf)
    found = G.append(segments.where("event_uid % 2 = 0"), links.where("segment_uid LIKE '%0/0'"), segments, links)
    return found[0].select("uid", F.lit("segment").alias("what")).union(found[1].select("uid", F.lit("link")))


def _deleted(spark, sf):
    segments, links = _segments(spark, sf), _links(spark, sf)
    left = G.delete(segments, links, segments.where("kind = 'image' OR event_uid % 5 = 0").select("uid"))
    left = G.delete_partition(*left, "3")
    return left[0].select("uid", F.lit("segment").alias("what")).union(left[1].select("uid", F.lit("link")))


def _derived(spark, sf):
    return G.derive(_segments(spark, sf)).select("segment_uid", F.sha2("text", 256).alias("hash"))


def _derived_sentences(spark, sf):
    return G.derive(_segments(spark, sf), per_sentence=True, date=None).select("segment_uid", "text")


def _declared(spark, sf):
    given = _events(spark, sf).select(F.col("event_uid").alias("uid"), F.col("producer").alias("source"), F.col("blocks")[0]["text"].alias("content"), F.when(F.col("event_uid") % 7 == 0, "image").when(F.col("event_uid") % 2 == 0, "message").otherwise("text").alias("content_type"))
    return G.derive_declarative(given).select("uid", "n", F.sha2("text", 256).alias("hash"))


def _halved(spark, sf) -> DataFrame:
    """The text blocks in two segments each."""
    given = _segments(spark, sf).where("kind = 'text'").drop("offset")
    return given.select(*[c for c in given.columns if c != "text"], F.posexplode(X.halves(F.col("text"))).alias("offset", "text"))


def _contexts(spark, sf):
    return R.contexts(_halved(spark, sf), ["partition_key"]).select("partition_key", F.sha2("text", 256).alias("hash"))


HEAD = "'[' || strftime(ts, '%A, %B %-d, %Y, %-I:%M %p') || '] ' || producer || ': ' || CAST(to_json(text) AS VARCHAR)"


def _silent(spark, sf):
    return R.contexts(_segments(spark, sf).where("kind = 'image'"), ["partition_key", "event_uid"], None, None).select("event_uid", "text")


def _joined(spark, sf):
    """Contexts of three turns around every fourth one: those that share turns are one."""
    given = _segments(spark, sf).where("kind = 'text'").withColumn("place", F.col("event_uid") % 1000)
    seeds = given.where("place % 4 = 1").select("partition_key", (F.col("place") - 1).alias("low"), (F.col("place") + 2 - (F.col("place") % 8 == 5).cast("int") * 2).alias("high"))
    rows = given.join(seeds, "partition_key").where("place BETWEEN low AND high")
    return R.joined_contexts(rows, ["partition_key"], "low", "high", "place", [], None, None).select("partition_key", F.sha2("text", 256).alias("hash"))


JOINED_SQL = f"""
WITH {TURNS}, d AS (SELECT conv_id, turn - 1 AS low, turn + 2 - CASE WHEN turn % 8 = 5 THEN 2 ELSE 0 END AS high FROM conversations WHERE turn % 4 = 1),
e AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY conv_id ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM d),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY low) AS island FROM e),
m AS (SELECT DISTINCT t.conv_id, island, turn, producer || ': ' || CAST(to_json(text) AS VARCHAR) AS line FROM t JOIN i ON t.conv_id = i.conv_id AND turn BETWEEN low AND high),
c AS (SELECT conv_id, island, min(turn) AS first, string_agg(line, chr(10) ORDER BY turn) AS text FROM m GROUP BY 1, 2)
SELECT CAST(conv_id AS VARCHAR) AS partition_key, sha256(string_agg(text, chr(10) || chr(10) ORDER BY first)) AS hash FROM c GROUP BY 1
"""


def _wrapped(spark, sf):
    """Each conversation's lines, a summary for even ones, and its number as the query, as one prompt."""
    given = _events(spark, sf).select("partition_key", F.col("ts").alias("created_at"), F.col("producer").alias("producer_id"), F.col("blocks")[0]["text"].alias("content"))
    lines = R.episode_lines(given, ["partition_key"], ["created_at"])
    even = F.col("partition_key").cast("long") % 2 == 0
    prompt = R.query_with_context(F.col("partition_key"), F.when(even, F.lit(" what was said ")), F.col("text"))
    return lines.select("partition_key", F.sha2(prompt, 256).alias("prompt"), F.sha2(R.search_result(F.col("text"), F.when(even, F.lit("{}"))), 256).alias("result"))


LINES = "m AS (SELECT conv_id, string_agg('[' || strftime(ts, '%A, %B %d, %Y at %I:%M %p') || '] ' || producer || ': ' || CAST(to_json(text) AS VARCHAR) || chr(10), '' ORDER BY turn) AS text FROM t GROUP BY 1)"
WRAPPED_SQL = f"""
WITH {TURNS}, {LINES} SELECT CAST(conv_id AS VARCHAR) AS partition_key,
sha256(CASE WHEN conv_id % 2 = 0 THEN '<Summary>' || chr(10) || 'what was said' || chr(10) || '</Summary>' || chr(10) ELSE '' END || '<Episodes>' || chr(10) || text || '</Episodes>' || chr(10) || '<Query>' || chr(10) || conv_id || chr(10) || '</Query>') AS prompt,
sha256('[Episodic Memory]' || chr(10) || text || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '[Semantic Memory]' || chr(10) || '{{}}' ELSE '' END) AS result FROM m
"""


def _packed(spark, sf):
    """Each conversation's turns in runs of at most four, and of 2,500 characters together."""
    lists = read(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    runs = lists.select("conv_id", F.posexplode(X.packed_array(F.col("texts"), 4, 2500)).alias("run", "texts"))
    return runs.select("conv_id", "run", F.size("texts").alias("n"), F.aggregate("texts", F.lit(0), lambda s, x: s + F.length(x)).alias("chars"))


PACKED_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS len FROM conversations),
w AS (SELECT conv_id, i, 0 AS run, 1 AS n, len AS chars FROM c WHERE i = 1
UNION ALL SELECT c.conv_id, c.i, CASE WHEN n >= 4 OR chars + len > 2500 THEN run + 1 ELSE run END, CASE WHEN n >= 4 OR chars + len > 2500 THEN 1 ELSE n + 1 END, CASE WHEN n >= 4 OR chars + len > 2500 THEN len ELSE chars + len END FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1)
SELECT conv_id, CAST(run AS INTEGER) AS run, CAST(max(n) AS INTEGER) AS n, CAST(max(chars) AS INTEGER) AS chars FROM w GROUP BY 1, 2
"""


def _regrouped(spark, sf):
    """The flat list of a conversation's turns back in lists of two and the rest."""
    lists = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("flat"))
    found = lists.select("conv_id", X.regrouped(F.col("flat"), F.when(F.size("flat") > 1, F.array(F.lit(2), F.size("flat") - 2)).otherwise(F.array(F.size("flat")))).alias("lists"))
    return found.select("conv_id", F.concat_ws("|", F.transform("lists", lambda x: F.concat_ws(",", x.cast("array<string>")))).alias("lists"))


QUERIES = {
    "segment_passthrough": (_passed, f"WITH {SEGMENTS} SELECT uid, event_uid, index, 0 AS \"offset\", kind, sha256(text) AS hash FROM g"),
    "segment_of_events": (_of_events, f"WITH {SEGMENTS} SELECT event_uid, string_agg(uid, ',' ORDER BY uid) AS segment_uids FROM g WHERE event_uid % 3 = 0 GROUP BY 1"),
    "segment_derivatives": (_derivatives, f"WITH {SEGMENTS}, {LINKS} SELECT segment_uid, string_agg(l.uid, ',' ORDER BY l.uid) AS derivative_uids FROM l JOIN g ON g.uid = segment_uid WHERE event_uid % 4 = 1 GROUP BY 1"),
    "segment_append": (_appended, f"WITH {SEGMENTS}, {LINKS} SELECT uid, 'segment' AS what FROM g UNION ALL SELECT uid, 'link' FROM l"),
    "segment_delete": (_deleted, f"WITH {SEGMENTS}, {LINKS}, k AS (SELECT uid FROM g WHERE kind = 'text' AND event_uid % 5 <> 0 AND partition_key <> '3') SELECT uid, 'segment' AS what FROM k UNION ALL SELECT l.uid, 'link' FROM l JOIN k ON k.uid = segment_uid"),
    "derive_whole": (_derived, f"WITH {SEGMENTS} SELECT uid AS segment_uid, sha256('[' || strftime(ts, '%A, %B %-d, %Y') || '] ' || producer || ': ' || CAST(to_json(text) AS VARCHAR)) AS hash FROM g WHERE text IS NOT NULL"),
    "derive_sentences": (_derived_sentences, f"SELECT conv_id * 1000 + turn || '/0' AS segment_uid, role || ': ' || CAST(to_json(sentence) AS VARCHAR) AS text FROM ({SENTENCE_SQL}) JOIN conversations USING (conv_id, turn)"),
    "derive_declarative": (_declared, f"WITH {TURNS} SELECT event_uid AS uid, 0 AS n, sha256(CASE WHEN event_uid % 2 = 0 THEN producer || ': ' || text ELSE text END) AS hash FROM t WHERE event_uid % 7 <> 0"),
    "render_contexts": (_contexts, f"WITH {TURNS} SELECT partition_key, sha256(string_agg({HEAD}, chr(10) ORDER BY turn)) AS hash FROM t GROUP BY 1"),
    "render_silent_blocks": (_silent, f"WITH {SEGMENTS} SELECT event_uid, 'user: [image]' || chr(10) || '\"\"' AS text FROM g WHERE kind = 'image'"),
    "render_joined_contexts": (_joined, JOINED_SQL),
    "render_prompt": (_wrapped, WRAPPED_SQL),
    "text_packed": (_packed, PACKED_SQL),
    "text_regrouped": (_regrouped, "SELECT conv_id, CASE WHEN count(*) > 1 THEN string_agg(turn, ',' ORDER BY turn) FILTER (i <= 2) || '|' || coalesce(string_agg(turn, ',' ORDER BY turn) FILTER (i > 2), '') ELSE string_agg(turn, ',') END AS lists FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY 1"),
}
