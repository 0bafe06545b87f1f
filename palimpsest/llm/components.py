"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Only DataFrame operations; edges stay distributed, each step is written to the
shared folder, so lineage is short and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them. edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Every node that has a lesser neighbour has just one, and that one has none: what both steps leave as it is."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    nodes = nodes.union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    sums = nodes.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return sums.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of every node that has an edge to another; component is the least node of its group.

    Loops, repeated and null edges do not matter; no edges give no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    current = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while not _stars(current):
        before, current = current, stored(_small_star(_large_star(current)), "edges")
        drop_stored(before)
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
