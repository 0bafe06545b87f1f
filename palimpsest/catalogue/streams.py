"""Streams with timers and initial state, and sessions by a time gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import clusters as K
from palimpsest.session import fresh_path, read
from palimpsest.streaming import ingest as I
from palimpsest.streaming import stateful as Z

from .common import HISTORY_SQL, history, messages
from .memory import _events_with_vectors


def _in_turn(df: DataFrame, part: str, parts: int) -> DataFrame:
    """A stream of df, a file per value of `part` (0 to parts - 1), the files in its order."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "source")
    for k in range(parts):
        df.where(F.col(part) == k).drop(part).coalesce(1).write.mode("append").parquet(path)
    return I.files(spark, path, df.drop(part).schema, 1)


def _due_by_age(spark, sf):
    """History in the order of time, in four batches, by the clock of the stream: sets with 30 rows pending, or one for over a day."""
    rows = history(spark, sf).withColumn("part", F.floor((F.dayofmonth("created_at") - 1) / 8).cast("int"))
    stream = _in_turn(rows, "part", 4).withWatermark("created_at", "0 seconds")
    out = fresh_path(spark, "due")
    Z.drain(spark, I.into_batches(Z.due_sets(stream, 30, 86_400, None, "event"), out), fresh_path(spark, "state"), idle=True)
    return I.read_batches(spark, out, Z.DUE).select("set_id").distinct()


DUE_SQL = f"""
WITH h AS ({HISTORY_SQL}), n AS (SELECT max(created_at) AS now FROM h), d AS (SELECT *, date_part('day', created_at)::INTEGER - 1 AS day FROM h)
SELECT set_id FROM d WHERE NOT ingested GROUP BY 1 HAVING count(*) >= 30 UNION SELECT set_id FROM h, n WHERE NOT ingested AND epoch_ms(created_at) + 86400000 <= epoch_ms(now)
"""


def _resumed(spark, sf):
    """Of each cluster's events those of the first half of time in batch, with their state saved; the rest streamed from it in two batches."""
    events = _events_with_vectors(spark, sf).select(F.col("label").cast("long").alias("set_id"), F.col("uid").alias("event_id"), "ts", F.col("embedding").cast("array<double>").alias("embedding"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    half, third = first + (last - first) / 2, first + (last - first) * 3 / 4
    early = events.where(F.col("ts") <= half)
    path = fresh_path(spark, "state-of-clusters")
    K.online_state(early, "set_id", "event_id", 0.15).write.parquet(path)
    late = events.where(F.col("ts") > half).withColumn("part", (F.col("ts") > third).cast("int"))
    out = fresh_path(spark, "clusters")
    Z.drain(spark, I.into_batches(Z.online_clusters(_in_turn(late, "part", 2), 0.15, initial=spark.read.parquet(path)), out), fresh_path(spark, "state"))
    streamed = I.read_batches(spark, out, "set_id long, event_id long, cluster int")
    return K.online(early, "set_id", "event_id", 0.15).unionByName(streamed).select(F.col("set_id").alias("label"), F.col("event_id").alias("uid"), "cluster")


#: Characters that the model of _summaries takes at once, and that its summary has at most.
TAKES, KEEPS = 700, 120


def _tail(summary: str, texts: list[str]) -> str:
    """A model with a short context: the end of all it has read."""
    whole = summary + "".join(texts)
    if len(whole) > TAKES:
        raise Z.TooLong(f"{len(whole)} characters")
    return whole[-KEEPS:]


def _summaries(spark, sf):
    """Turns arrive in three batches, the second of them twice; what 500 characters do not hold goes into the summary."""
    rows = messages(spark, sf).select(F.col("session_key").cast("long").alias("session_key"), F.col("sequence_num").cast("long").alias("sequence_num"), "content", F.least(F.floor(F.col("sequence_num") / 3), F.lit(2)).cast("int").alias("part"))
    again = rows.where("part = 1").withColumn("part", F.lit(2)).union(rows.where("part = 2").withColumn("part", F.lit(3))).union(rows.where("part < 2"))
    out = fresh_path(spark, "summaries")
    Z.drain(spark, I.into_batches(Z.summaries(_in_turn(again, "part", 4), 500, _tail), out), fresh_path(spark, "state"))
    last = I.read_batches(spark, out, Z.SUMMARY).groupBy("session_key").agg(F.max(F.struct("sequence_num", "summarised", "waiting", "summary")).alias("s"))
    return last.select("session_key", "s.sequence_num", "s.summarised", "s.waiting", "s.summary")


SUMMARIES_SQL = f"""
WITH c AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC), 0) AS chars FROM conversations)
SELECT conv_id AS session_key, max(turn) AS sequence_num, count(*) FILTER (chars > 500) AS summarised, 0 AS waiting, right(coalesce(string_agg(text, '' ORDER BY turn) FILTER (chars > 500), ''), {KEEPS}) AS summary FROM c GROUP BY 1
"""


#: Parts of the time of the events that _windows streams one after the other.
WINDOW_PARTS = 6


def _windows(spark, sf):
    """Events of a user with pauses of at most six hours, streamed; the watermark closes all but the last sessions, so a row a year later follows."""
    df = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # in the order of time, so that a batch sorts a part of the rows only and none comes late
    first, last = df.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    df = df.withColumn("part", F.floor((F.unix_micros("ts") - F.lit(first)) * WINDOW_PARTS / (F.lit(last) - F.lit(first) + 1)).cast("int"))
    later = df.groupBy().agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(WINDOW_PARTS).alias("part"))
    found = I.session_windows(_in_turn(df.union(later), "part", WINDOW_PARTS + 1), "ts", "6 hours", ["user_id"])
    out = fresh_path(spark, "windows")
    I.drain(I.into_batches(found.select("user_id", F.col("session_window.start").alias("start"), "n"), out).outputMode("append"), fresh_path(spark, "state"))
    return I.read_batches(spark, out, "user_id long, start timestamp, n long").where("user_id >= 0").withColumn("start", F.unix_micros("start"))


WINDOWS_SQL = """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS begins FROM events), s AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k
"""

QUERIES = {
    "stream_trigger_age": (_due_by_age, DUE_SQL),
    "stream_clusters_resumed": (_resumed, None),
    "stream_summaries": (_summaries, SUMMARIES_SQL),
    "stream_session_windows": (_windows, WINDOWS_SQL),
}
