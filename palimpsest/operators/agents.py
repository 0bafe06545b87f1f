"""Retrieval tools that compose: a tool turns queries (query_id, query_text) into rows (query_id, uid, created_at, ...).

Planners (splitting, rewriting, judging, choosing) are functions over a query's text or
what was found for it: the place of a language model. The loop runs on the
driver, once per round and not per query; every step is one DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from palimpsest.session import stored

from .longterm import evidence_union

Tool = Callable[[DataFrame], DataFrame]


def _by_text(kind: T.DataType, plan: Callable):
    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: plan(t or ""))

    return run


def newest_of_key(rows: DataFrame, key: str, asked: Column, k: int, created_at: str = "created_at", uid: str = "uid") -> Tool:
    """A tool that finds the k newest rows whose key equals what a query asks for (`asked`, over query_text); ties go to the greater uid.

    Rows are ranked within their key before queries come in, so that a key brings
    at most k rows to a query however many rows have it, and tasks pass on at most
    k rows of a key. Null keys, and queries that ask for null, find nothing.
    """
    order = W.partitionBy(key).orderBy(F.col(created_at).desc_nulls_last(), F.col(uid).desc())
    newest = rows.where(F.col(key).isNotNull()).withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place")

    def run(queries: DataFrame) -> DataFrame:
        return queries.withColumn(key, asked).join(newest, key).select("query_id", *[c for c in rows.columns if c != key])

    return run


def totals_of_key(rows: DataFrame, key: str, asked: Column, *totals: Column) -> Tool:
    """A tool that tells a query the totals of all rows whose key equals what it asks for (`asked`, over query_text).

    Rows are added up within their key before queries come in, so that a key brings
    one row to a query however many rows have it. Null keys, and queries that ask for
    null, find nothing.
    """
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*totals)

    def run(queries: DataFrame) -> DataFrame:
        return queries.withColumn(key, asked).join(found, key).select("query_id", *[c for c in found.columns if c != key])

    return run


def split_query(tool: Tool, plan: Callable[[str], list[str]]) -> Tool:
    """The rows that a tool finds for the parts of each query, repeats included; a query without parts stands for itself."""

    def run(queries: DataFrame) -> DataFrame:
        parts = queries.withColumn("part", _by_text(T.ArrayType(T.StringType()), plan)("query_text"))
        parts = parts.select(F.col("query_id").alias("whole"), F.posexplode(F.when(F.size("part") > 0, F.col("part")).otherwise(F.array("query_text"))).alias("n", "query_text"))
        asked = parts.select(F.struct("whole", "n").alias("query_id"), "query_text")
        found = tool(asked)
        return found.withColumn("query_id", F.col("query_id.whole"))

    return run


def select_tool(tools: dict[str, Tool], choose: Callable[[str], str], default: str) -> Tool:
    """Each query by the tool that is chosen for it; an unknown choice gives the default."""

    def run(queries: DataFrame) -> DataFrame:
        named = queries.withColumn("__tool", _by_text(T.StringType(), choose)("query_text"))
        named = named.withColumn("__tool", F.when(F.col("__tool").isin(*tools), F.col("__tool")).otherwise(default))
        found = None
        for name, tool in tools.items():
            rows = tool(named.where(F.col("__tool") == name).drop("__tool"))
            found = rows if found is None else found.unionByName(rows)
        return found

    return run


def chain_of_queries(tool: Tool, judge: Callable[[str, list[str]], tuple[bool, float, str]], rounds: int = 3, confident: float = 0.8, text: str = "content") -> Tool:
    """Asks again with a rewritten query until what was found is sufficient and the judge confident, `rounds` times at most.

    judge(query, texts) gives whether they suffice, the confidence, and the next
    query. What earlier rounds found stays as evidence, once each, in the order of time.
    """
    verdict = T.StructType([T.StructField("enough", T.BooleanType()), T.StructField("confidence", T.DoubleType()), T.StructField("query_text", T.StringType())])

    @F.pandas_udf(verdict)
    def decide(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for queries, texts in parts:
            yield pd.DataFrame([judge(q or "", list(t) if t is not None else []) for q, t in zip(queries, texts)], columns=["enough", "confidence", "query_text"])

    def run(queries: DataFrame) -> DataFrame:
        open_queries, evidence = queries.select("query_id", "query_text"), []
        for n in range(rounds):
            evidence.append(tool(open_queries))
            if n + 1 == rounds:
                break
            known = evidence_union(evidence, ["query_id"])
            lists = known.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", text))), lambda x: x[text]).alias("texts"))
            judged = open_queries.join(lists, "query_id", "left").withColumn("verdict", decide("query_text", "texts"))
            open_queries = judged.where(~(F.col("verdict.enough") & (F.col("verdict.confidence") >= confident))).select("query_id", "verdict.query_text")
            open_queries = stored(open_queries, "queries")
            if open_queries.isEmpty():
                break
        return evidence_union(evidence, ["query_id"])

    return run
