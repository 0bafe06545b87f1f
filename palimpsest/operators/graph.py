"""Property graphs as two tables: nodes(collection, uid, ...) and edges(relation, source_uid, target_uid, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_edges(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and those new ones whose both ends exist."""
    ids = nodes.select(F.col("uid").alias("__id"))
    sound = new.join(ids, F.col("source_uid") == F.col("__id"), "left_semi").join(ids, F.col("target_uid") == F.col("__id"), "left_semi")
    return edges.unionByName(sound)


def related(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "out", edge_where: Column | None = None, node_where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Distinct nodes one edge away from each seed (column seed), along out, in or both directions.

    Equi-joins on node ids only; for both directions the two sets are united.
    """
    given = edges if edge_where is None else edges.where(edge_where)
    ends = []
    if direction in ("out", "both"):
        ends.append(given.select(F.col("source_uid").alias("seed"), F.col("target_uid").alias("uid")))
    if direction in ("in", "both"):
        ends.append(given.select(F.col("target_uid").alias("seed"), F.col("source_uid").alias("uid")))
    if not ends:
        raise ValueError("direction is out, in or both")
    hops = ends[0] if len(ends) == 1 else ends[0].union(ends[1])
    hops = hops.join(seeds.select("seed").distinct(), "seed", "left_semi").distinct()
    found = hops.join(nodes if node_where is None else nodes.where(node_where), "uid")
    return found if limit is None else found.orderBy("seed", "uid").limit(limit)


def detach(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given nodes (column uid) and the edges at them."""
    ids = gone.select(F.col("uid").alias("__id")).distinct()
    left = edges.join(ids, F.col("source_uid") == F.col("__id"), "left_anti").join(ids, F.col("target_uid") == F.col("__id"), "left_anti")
    return nodes.join(ids, F.col("uid") == F.col("__id"), "left_anti"), left


def cascade(gone: DataFrame, links: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Ids to delete level by level: links are (table, parent key, child key), the first level's ids are column uid of gone."""
    out, ids = [], gone.select("uid").distinct()
    for table, parent, child in links:
        ids = table.join(ids, F.col(parent) == F.col("uid"), "left_semi").select(F.col(child).alias("uid")).distinct()
        out.append(ids)
    return out


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The nodes with new ones; a uid that is there already raises when the result is read."""
    known = nodes.select("uid", F.lit(True).alias("__known"))
    checked = new.join(known, "uid", "left").withColumn("uid", F.when(F.col("__known"), F.raise_error(F.concat(F.lit("a node is there already: "), F.col("uid").cast("string")))).otherwise(F.col("uid"))).drop("__known")
    return nodes.unionByName(checked)
