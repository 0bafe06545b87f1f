"""Joins of time intervals by client, reported per left row and relation.

Times are whole microseconds since 1970; intervals are compared by slots of equal
length, both ends inclusive; an open end is later than all others and equal to
other open ends.

Intervals of a client that cover the same slots behave alike. So the two sides are
first reduced to classes (client, first slot, last slot): on one side distinct,
on the other with their number and summed weight. What a client brings to the
join is then bounded by its horizon in slots, whatever its rows.

Classes are replicated into buckets of BUCKET slots, open ends clipped to the
client's horizon (its latest slot on either side), and meet in an equi-join of
client and bucket. A pair that meets in several buckets counts in the one that holds
the later start. The sums of a class go back to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Microseconds.
MINUTE, DAY = 60_000_000, 86_400_000_000
#: Silence after which a click begins another session.
GAP = 5 * MINUTE
#: Slots of a bucket of the join.
BUCKET = 16
#: Spans (of GAP) that one window of the session search holds of a client.
SPANS = 288
#: Last slot of an open interval.
OPEN = (1 << 63) - 1


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 UTC; times without a zone are UTC, whatever the session's zone."""
    time = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_micros(time)
    time = time.cast("timestamp_ntz")
    seconds = F.unix_date(time.cast("date")).cast("long") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def whole(value: Column, by: int) -> Column:
    """value / by, rounded down."""
    width = F.lit(by).cast("long")
    return F.call_function("div", value - F.pmod(value, width), width)


def sessions(clicks: DataFrame, gap: int = GAP) -> DataFrame:
    """client_id, first, last (microseconds), open, of each run of a client's clicks without a silence over `gap`.

    open says whether one of the clicks at the last time has kind click. Rows
    without client or time take no part, repeated rows do not matter.

    Clicks of one span of `gap` are always one run, so they are summed up on the map
    side; only neighbouring spans can continue each other. A client's spans are
    looked through in blocks of SPANS with the neighbouring spans of the blocks beside
    them. What is left of a client are the first and last spans of its sessions.
    """
    rows = clicks.select(F.col("client_id"), micros(clicks, "ts").alias("at"), F.coalesce(F.col("kind") == "click", F.lit(False)).cast("long").alias("click")).where("client_id IS NOT NULL AND at IS NOT NULL")
    # the last bit of `latest` says whether a click stands at the latest time
    spans = rows.groupBy("client_id", whole(F.col("at"), gap).alias("span")).agg(F.min("at").alias("first"), F.max(F.col("at") * 2 + F.col("click")).alias("latest"))
    place = F.pmod("span", F.lit(SPANS).cast("long"))
    homes = F.array_compact(F.array(F.lit(0), F.when(place == 0, F.lit(-1)), F.when(place == SPANS - 1, F.lit(1))))
    placed = spans.select("*", F.explode(homes).alias("away")).withColumn("block", whole(F.col("span"), SPANS) + F.col("away"))
    in_block, in_client = W.partitionBy("client_id", "block").orderBy("span"), W.partitionBy("client_id").orderBy("span")
    last = F.shiftright("latest", 1)
    apart = lambda later, earlier: F.coalesce(later - earlier > gap, F.lit(True))
    seen = placed.select("*", apart(F.col("first"), F.lag(last).over(in_block)).alias("begins"), apart(F.lead("first").over(in_block), last).alias("ends"))
    edges = seen.where("away = 0 AND (begins OR ends)").select("client_id", "span", "first", "latest", "begins", "ends")
    paired = edges.withColumn("latest", F.when(F.col("ends"), F.col("latest")).otherwise(F.lead("latest").over(in_client))).where("begins")
    return paired.select("client_id", "first", last.alias("last"), (F.col("latest").bitwiseAND(F.lit(1).cast("long")) == 1).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sale_id, client_id, first, last (microseconds), open (status held) of each sale that has a client and a time.

    A sale lasts until the latest time its lines were shipped at, if that is later.
    Lines without sale or time take no part. Each row of sales is a sale.
    """
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("at")).where("sale_id IS NOT NULL AND at IS NOT NULL").groupBy("sale_id").agg(F.max("at").alias("shipped"))
    open_ = F.coalesce(F.col("status") == "held", F.lit(False))
    own = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("first"), open_.alias("open")).where("client_id IS NOT NULL AND first IS NOT NULL")
    return own.join(shipped, "sale_id", "left").select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), "open")


def _slots(intervals: DataFrame, slot: int, *more: Column) -> DataFrame:
    return intervals.select(F.col("client_id"), whole(F.col("first"), slot).alias("start"), F.when(F.col("open"), F.lit(OPEN)).otherwise(whole(F.col("last"), slot)).alias("end"), *more)


def relation(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Name of how the interval lies to the other one."""
    by_end = lambda earlier, equal, later: F.when(end < other_end, earlier).when(end == other_end, equal).otherwise(later)
    return F.when(start < other_start, by_end("overlaps", "finished_by", "contains")).when(start == other_start, by_end("starts", "equals", "started_by")).otherwise(by_end("during", "finishes", "overlapped_by"))


def relate(left: DataFrame, right: DataFrame, key: str, weight: Column, slot: int = DAY, bucket: int = BUCKET) -> DataFrame:
    """key, relation, n_pairs, overlap_slots, weights per left row and relation it has to right intervals of its client.

    Both sides have client_id, first, last, open. Pairs share a slot at least.
    overlap_slots sums shared slots and is null where both ends are open; weights sums
    `weight` of the right rows. Rows with a null client or time take no part; an empty
    side gives no row; equal rows each count; further columns do not matter.
    """
    mine = _slots(left, slot, F.col(key).alias("row_key")).where("client_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    theirs = _slots(right, slot, weight.alias("weight")).where("client_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    groups = theirs.groupBy("client_id", "start", "end").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    none = F.lit(None).cast("long")
    both = mine.select("client_id", "start", "end").distinct().select("*", none.alias("n"), none.alias("weight")).union(groups)
    latest = F.max(F.greatest(F.col("start"), F.when(F.col("end") < OPEN, F.col("end")))).over(W.partitionBy("client_id"))
    clipped = both.withColumn("until", F.least(F.col("end"), latest))
    spread = clipped.select("client_id", "start", "end", "n", "weight", F.explode(F.sequence(whole(F.col("start"), bucket), whole(F.col("until"), bucket))).alias("bucket"))
    a = spread.where("n IS NULL").select("client_id", "bucket", "start", "end")
    b = spread.where("n IS NOT NULL").select("client_id", "bucket", F.col("start").alias("start_"), F.col("end").alias("end_"), "n", "weight")
    later = F.greatest("start", "start_")
    pairs = a.join(b, ["client_id", "bucket"]).where((F.col("start") <= F.col("end_")) & (F.col("start_") <= F.col("end")) & (F.col("bucket") == whole(later, bucket)))
    until = F.least("end", "end_")
    found = pairs.select("client_id", "start", "end", relation(F.col("start"), F.col("end"), F.col("start_"), F.col("end_")).alias("relation"), "n", (F.when(until < OPEN, until - later + 1) * F.col("n")).alias("shared"), "weight")
    sums = found.groupBy("client_id", "start", "end", "relation").agg(F.sum("n").alias("n_pairs"), F.sum("shared").alias("overlap_slots"), F.sum("weight").alias("weights"))
    return mine.join(sums, ["client_id", "start", "end"]).select(F.col("row_key").alias(key), "relation", "n_pairs", "overlap_slots", "weights")


def sales_and_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame, gap: int = GAP, slot: int = DAY) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots, sessions_crc: relate() of the sales to the sessions of their clients, crc32 of the sessions' first times as weights."""
    found = relate(sale_intervals(sales, lines), sessions(clicks, gap), "sale_id", F.crc32(F.col("first").cast("string")), slot)
    return found.withColumnRenamed("weights", "sessions_crc")
