"""Neighbours, keyset scans, budgets, islands and graph hops."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import context as C
from palimpsest.operators import graph as G
from palimpsest.session import read

from .common import episodes, where

ORDER = ["created_at", "uid"]


def _neighbours(text: str | None = None):
    def run(spark, sf):
        df = episodes(spark, sf)
        found = C.neighbours(df, df.where("uid % 50 = 0").select(F.col("uid").alias("seed")), ["session_key"], ORDER, "uid", 2, 4, where(text) if text else None)
        return found.select("seed", "uid", "distance", "session_key")

    return run


def _neighbours_sql(condition: str = "true") -> str:
    return (
        f"WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE {condition}) "
        "SELECT s.event_id AS seed, n.event_id AS uid, CAST(n.r - s.r AS INTEGER) AS distance, n.user_id AS session_key FROM n s JOIN n ON n.user_id = s.user_id AND n.r BETWEEN s.r - 2 AND s.r + 4 WHERE s.event_id % 50 = 0"
    )


def _keyset_forward(spark, sf):
    df = episodes(spark, sf)
    return C.keyset(df, ["session_key", "created_at", "uid"], [F.lit(7), F.to_timestamp(F.lit("2024-01-15 00:00:00")), F.lit(0)], [True, True, True], limit=200).select("uid", "session_key")


def _keyset_mixed(spark, sf):
    return C.keyset(episodes(spark, sf), ["k", "uid"], [F.lit(50), F.lit(4000)], [False, True], include_equal=True, limit=150, where=where("producer_role = view")).select("uid", "k")


def _budget(spark, sf):
    """Contexts of three seeds per user, in the order of the seeds' value."""
    df = episodes(spark, sf)
    seeds = df.where("uid % 100 = 0").select(F.col("uid").alias("seed"), F.row_number().over(C.W.partitionBy("session_key").orderBy(F.desc("value"), "uid")).alias("context_rank"))
    found = C.neighbours(df, seeds, ["session_key"], ORDER, "uid", 2, 4).join(seeds, "seed")
    return C.budget_union(found, 6, ["session_key"], "uid").select("session_key", "uid", "seed", "distance")


BUDGET_SQL = """
WITH n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS context_rank FROM n WHERE event_id % 100 = 0),
c AS (SELECT n.user_id, n.event_id AS uid, s.event_id AS seed, s.context_rank, n.r - s.r AS d FROM s JOIN n ON n.user_id = s.user_id AND n.r BETWEEN s.r - 2 AND s.r + 4),
o AS (SELECT *, CASE WHEN d >= 0 THEN (d - 0.5) / 2 ELSE -d END AS p FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, uid ORDER BY context_rank, p) AS i FROM o),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY context_rank, p, uid) AS j FROM f WHERE i = 1)
SELECT user_id AS session_key, uid, seed, CAST(d AS INTEGER) AS distance FROM g WHERE j <= 6
"""


def _islands(spark, sf):
    """Contexts of seeds are intervals of row numbers; those that share rows are one island."""
    df = episodes(spark, sf).withColumn("n", F.row_number().over(C.W.partitionBy("session_key").orderBy(*ORDER)))
    spans = df.where("uid % 20 = 0").select("session_key", "uid", (F.col("n") - 2).alias("low"), (F.col("n") + 4).alias("high"))
    return C.islands(spans, ["session_key"], "low", "high").select("session_key", "uid", F.col("island").cast("long").alias("island"))


ISLANDS_SQL = """
WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, event_id, r - 2 AS low, r + 4 AS high FROM n WHERE event_id % 20 = 0),
f AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY user_id ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s)
SELECT user_id AS session_key, event_id AS uid, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY low) AS BIGINT) AS island FROM f
"""


def _nodes_edges(spark, sf):
    customers = read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("uid"), F.col("c_mktsegment").alias("kind"))
    orders = read(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("uid"), F.col("o_orderstatus").alias("kind"))
    edges = read(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("source_uid"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("target_uid"), F.col("o_totalprice").alias("price"))
    return customers.union(orders), edges


def _seeds(nodes):
    return nodes.where("uid rlike '^[co][0-9]*7$'").select(F.col("uid").alias("seed"))


def _related(direction: str):
    def run(spark, sf):
        nodes, edges = _nodes_edges(spark, sf)
        return G.related(nodes, edges, _seeds(nodes), direction).select("seed", "uid", "kind")

    return run


OUT = "SELECT DISTINCT 'c' || o_custkey AS seed, 'o' || o_orderkey AS uid, o_orderstatus AS kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 10 = 7"
IN = "SELECT DISTINCT 'o' || o_orderkey AS seed, 'c' || c_custkey AS uid, c_mktsegment AS kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 10 = 7"


def _match(spark, sf):
    nodes, edges = _nodes_edges(spark, sf)
    return G.related(nodes, edges, nodes.where("uid LIKE 'c%'").select(F.col("uid").alias("seed")), "out", F.col("price") > 100000, F.col("kind") == "O").select("seed", "uid")


def _detach(spark, sf):
    nodes, edges = _nodes_edges(spark, sf)
    left, kept = G.detach(nodes, edges, nodes.where("kind = 'BUILDING'").select("uid"))
    return left.select("uid", F.lit("node").alias("what")).union(kept.select("target_uid", F.lit("edge")))


def _cascade(spark, sf):
    orders, lines = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    gone = read(spark, sf, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("uid"))
    levels = G.cascade(gone, [(orders, "o_custkey", "o_orderkey"), (lines, "l_orderkey", "l_partkey")])
    return levels[0].withColumn("level", F.lit(1)).union(levels[1].withColumn("level", F.lit(2)))


QUERIES = {
    "ctx_neighbours": (_neighbours(), _neighbours_sql()),
    "ctx_neighbours_filtered": (_neighbours("producer_role IN (view, click) AND m.k < 80"), _neighbours_sql("event_type IN ('view', 'click') AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 80")),
    "ctx_keyset_forward": (_keyset_forward, "SELECT event_id AS uid, user_id AS session_key FROM events WHERE user_id > 7 OR (user_id = 7 AND ts > TIMESTAMP '2024-01-15') OR (user_id = 7 AND ts = TIMESTAMP '2024-01-15' AND event_id > 0) ORDER BY user_id, ts, event_id LIMIT 200"),
    "ctx_keyset_backward_mixed": (_keyset_mixed, "WITH e AS (SELECT event_id AS uid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view') SELECT uid, k FROM e WHERE k < 50 OR (k = 50 AND uid >= 4000) ORDER BY k DESC, uid LIMIT 150"),
    "ctx_budget_union": (_budget, BUDGET_SQL),
    "ctx_islands": (_islands, ISLANDS_SQL),
    "graph_out": (_related("out"), OUT),
    "graph_in": (_related("in"), IN),
    "graph_both": (_related("both"), f"{OUT} UNION {IN}"),
    "graph_match": (_match, "SELECT DISTINCT 'c' || o_custkey AS seed, 'o' || o_orderkey AS uid FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000 AND o_orderstatus = 'O'"),
    "graph_detach": (_detach, "SELECT 'c' || c_custkey AS uid, 'node' AS what FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'o' || o_orderkey, 'node' FROM orders WHERE o_orderstatus <> 'BUILDING' UNION ALL SELECT 'o' || o_orderkey, 'edge' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "graph_cascade": (_cascade, "WITH o AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 100 = 0)) SELECT o_orderkey AS uid, 1 AS level FROM o UNION ALL SELECT DISTINCT l_partkey, 2 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)"),
}
