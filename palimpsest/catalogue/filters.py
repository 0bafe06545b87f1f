"""Filter language and episode scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import tables as T
from palimpsest.plans.filters import compile_filter, parse_filter, resolver

from .common import episodes, typed_episodes, where

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _filtered(text: str, two_valued: bool = False):
    return lambda spark, sf: episodes(spark, sf).where(where(text, two_valued)).select("uid", "session_key", "producer_role", "value")


def _oracle(condition: str) -> str:
    return f"SELECT event_id AS uid, user_id AS session_key, event_type AS producer_role, value FROM events WHERE {condition}"


def _typed(text: str):
    def run(spark, sf):
        condition = compile_filter(parse_filter(text), resolver({}, "properties", typed=True))
        return typed_episodes(spark, sf).where(condition).select("uid")

    return run


def _page(spark, sf):
    df = episodes(spark, sf).where(where("producer_role IN (click, view)"))
    return T.page(df, [F.col("created_at"), F.col("uid")], 50, 3).select("uid", "session_key")


def _window(spark, sf):
    """Both ends count."""
    condition = where("created_at >= date('2024-01-05T00:00:00Z') AND created_at <= date('2024-01-12T12:00:00+02:00') AND NOT producer_role = error")
    return episodes(spark, sf).where(condition).select("uid", "producer_role")


def _lookup(spark, sf):
    df = episodes(spark, sf)
    return T.by_ids(df, df.where("uid % 97 = 0").select("uid").union(df.where("uid % 194 = 0").select("uid")), "uid").select("uid", "value")


def _deleted(spark, sf):
    return T.without_matches(episodes(spark, sf), where("m.k > 20 AND value < 90.0 OR m.missing = 1")).select("uid")


def _deleted_ids(spark, sf):
    df = episodes(spark, sf)
    return T.without_ids(df, df.where("uid % 7 = 0").select("uid"), "uid").select("uid")


def _count(spark, sf):
    return episodes(spark, sf).where(where("m.k >= 50 AND producer_role != error")).agg(F.count("*").alias("n"))


def _counts(spark, sf):
    return episodes(spark, sf).groupBy("session_key").agg(F.count("*").alias("n"))


def _ids(spark, sf):
    return episodes(spark, sf).where(where("producer_role = signup")).orderBy("created_at", "uid").limit(100).select("uid")


QUERIES = {
    "filter_compare": (_filtered("value >= 50.5 AND producer_role <> 'error' AND uid < 9000"), _oracle("value >= 50.5 AND event_type <> 'error' AND event_id < 9000")),
    "filter_in": (_filtered("producer_role IN (click, 'view') AND session IN (1, 2, 3, 50)"), _oracle("event_type IN ('click', 'view') AND user_id IN (1, 2, 3, 50)")),
    "filter_not_in": (_filtered("Producer_Role NOT IN (click, view)"), _oracle("event_type NOT IN ('click', 'view')")),
    "filter_null": (_filtered("m.missing IS NULL AND m.k IS NOT NULL AND value IS NOT NULL"), _oracle("json_extract_string(props, '$.missing') IS NULL AND json_extract_string(props, '$.k') IS NOT NULL AND value IS NOT NULL")),
    "filter_bool_logic": (_filtered("producer_role = click OR producer_role = view AND NOT (m.k > 30 OR value < 10.0)"), _oracle(f"event_type = 'click' OR event_type = 'view' AND NOT ({K} > 30 OR value < 10.0)")),
    "filter_date": (_filtered("created_at < date('2024-01-10T06:30:00.5+01:00')"), _oracle("ts < TIMESTAMP '2024-01-10 05:30:00.5'")),
    "filter_json_meta": (_filtered("producer_role = 'purchase' AND m.k >= 50 AND NOT metadata.other = 1 OR metadata.k IN (1, 2)"), _oracle(f"event_type = 'purchase' AND {K} >= 50 AND NOT TRY_CAST(json_extract_string(props, '$.other') AS BIGINT) = 1 OR {K} IN (1, 2)")),
    "filter_typed_props": (_typed("m.k > 40 AND m.even = true AND NOT m.value >= 50.0"), f"SELECT event_id AS uid FROM events WHERE {K} > 40 AND (CASE WHEN event_id % 3 <> 0 THEN event_id % 2 = 0 END) AND NOT (CASE WHEN value < 100 THEN value >= 50 END)"),
    "filter_typed_mismatch": (_typed("NOT m.k = 10.0 AND m.type IN (click, error) OR m.at >= date('2024-01-29')"), "SELECT event_id AS uid FROM events WHERE (NOT false AND event_type IN ('click', 'error')) OR ts >= TIMESTAMP '2024-01-29'"),
    "filter_two_valued": (_filtered("NOT m.other = 1 AND m.other != 3 AND m.k < 25", True), _oracle(f"{K} < 25")),
    "episode_window_scan": (_window, "SELECT event_id AS uid, event_type AS producer_role FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 10:00:00' AND NOT event_type = 'error'"),
    "episode_page": (_page, "SELECT event_id AS uid, user_id AS session_key FROM events WHERE event_type IN ('click', 'view') ORDER BY ts, event_id LIMIT 50 OFFSET 150"),
    "episode_count": (_count, f"SELECT count(*) AS n FROM events WHERE {K} >= 50 AND event_type <> 'error'"),
    "episode_count_by_session": (_counts, "SELECT user_id AS session_key, count(*) AS n FROM events GROUP BY 1"),
    "episode_ids": (_ids, "SELECT event_id AS uid FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 100"),
    "episode_lookup": (_lookup, "SELECT event_id AS uid, value FROM events WHERE event_id % 97 = 0"),
    "episode_delete": (_deleted, f"SELECT event_id AS uid FROM events WHERE NOT coalesce({K} > 20 AND value < 90, false)"),
    "episode_delete_ids": (_deleted_ids, "SELECT event_id AS uid FROM events WHERE event_id % 7 <> 0"),
}
