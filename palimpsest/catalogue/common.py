"""Model tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.properties import typed_map, typed_value
from palimpsest.plans.filters import compile_filter, parse_filter, resolver
from palimpsest.session import read


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """uid, created_at, session_key, producer_role, value, metadata (JSON), k of the events."""
    return read(spark, sf, "events").select(
        F.col("event_id").alias("uid"), F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("session_key"), F.col("event_type").alias("producer_role"), "value", F.col("props").alias("metadata"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
    )


EPISODE_FIELDS = {"uid": "uid", "id": "uid", "created_at": "created_at", "session_key": "session_key", "session": "session_key", "producer_role": "producer_role", "value": "value"}


def where(text: str, two_valued: bool = False):
    """The predicate of a filter text over episodes."""
    return compile_filter(parse_filter(text), resolver(EPISODE_FIELDS, "metadata", ignore_case=True), two_valued)


def typed_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes with a typed map: k int, value float where it is under 100, type str, even bool for even ids, at datetime."""
    df = episodes(spark, sf)
    entries = {
        "k": typed_value("int", F.col("k")),
        "value": typed_value("float", F.when(F.col("value") < 100, F.col("value"))),
        "type": typed_value("str", F.col("producer_role")),
        "even": typed_value("bool", F.when(F.col("uid") % 3 != 0, F.col("uid") % 2 == 0)),
        "at": typed_value("datetime", F.col("created_at"), F.lit(0)),
    }
    return df.withColumn("properties", typed_map(entries))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """uid, session_key, sequence_num, producer_role, content of the conversations."""
    return read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), F.col("conv_id").alias("session_key"), F.col("turn").alias("sequence_num"), F.col("role").alias("producer_role"), F.col("text").alias("content"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """id, set_id, category, tag, feature, value, created_at: a feature store made of the events."""
    return episodes(spark, sf).select(
        F.col("uid").alias("id"), F.concat(F.lit("user_"), F.col("session_key")).alias("set_id"), F.lit("profile").alias("category"), F.col("producer_role").alias("tag"),
        F.concat(F.lit("k"), F.col("k") % 5).alias("feature"), F.col("value").cast("string").alias("value"), "created_at",
    )


FEATURES_SQL = "SELECT event_id AS id, 'user_' || user_id AS set_id, 'profile' AS category, event_type AS tag, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS feature, value, ts AS created_at FROM events"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """set_id, history_id, created_at, ingested: two of three events are ingested, all those of users divisible by 4."""
    return episodes(spark, sf).select(F.concat(F.lit("user_"), F.col("session_key")).alias("set_id"), F.col("uid").cast("string").alias("history_id"), "created_at", ((F.col("uid") % 3 != 0) | (F.col("session_key") % 4 == 0)).alias("ingested"))


HISTORY_SQL = "SELECT 'user_' || user_id AS set_id, CAST(event_id AS VARCHAR) AS history_id, ts AS created_at, (event_id % 3 <> 0 OR user_id % 4 = 0) AS ingested FROM events"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), "embedding", "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector as a query: the stated query set; candidates are all vectors."""
    return vectors(spark, sf).where("uid % 20 = 0").select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))
