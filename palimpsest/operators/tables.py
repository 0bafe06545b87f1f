"""Table operators: keyed lookup, paging, upsert, delete, merge. Deletes and updates are new tables, never in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids (first column), once each however often an id is given."""
    return df.join(ids.toDF("__id").distinct(), F.col(key) == F.col("__id"), "left_semi")


def in_order_of(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of the given ids with the position of each, missing ids skipped; a position per occurrence of the id. Ids travel as a table, not as literals of the plan."""
    kind = df.schema[key].dataType.simpleString()
    given = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, __id {kind}")
    return df.join(given, F.col(key) == F.col("__id")).drop("__id").orderBy("pos")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.toDF("__id"), F.col(key) == F.col("__id"), "left_anti")


def without_matches(df: DataFrame, condition: Column) -> DataFrame:
    """What a delete by condition leaves: rows for which it is false or unknown."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def page(df: DataFrame, order: list[Column], size: int | None = None, number: int | None = None) -> DataFrame:
    """Page `number`, from 0, of `size` rows; a number without a size raises. The order must end in a unique key."""
    if size is None:
        if number:
            raise ValueError("a page number needs a page size")
        return df.orderBy(*order)
    ordered = df.orderBy(*order)
    return (ordered.offset(size * number) if number else ordered).limit(size)


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: Column | str) -> DataFrame:
    """Old and new rows; of equal keys the one of the highest version, then a new one, then the one of the least hash."""
    newest = W.partitionBy(*key).orderBy(F.desc(version), F.desc("__new"), F.xxhash64(*old.columns))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__new")


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there: of several new rows of a key the one of the least hash."""
    fresh = first_of(new, key, [F.xxhash64(*sorted(old.columns))])
    return old.unionByName(fresh.join(old, key, "left_anti"))


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with the non-null columns of the changes for their key."""
    few = changes.select(F.col(key).alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(few, F.col(key) == F.col("__id"), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def rewrite_keys(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """The table with keys replaced by a mapping (old, new); others stay."""
    return df.join(mapping.toDF("__old", "__new"), F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def collisions(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """New keys of a mapping that the table holds already."""
    return mapping.toDF("__old", "__new").join(df, F.col("__new") == F.col(column), "left_semi").select(F.col("__new").alias(column))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of equal keys the first row by the order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def with_rows_of(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, value: str, name: str) -> DataFrame:
    """Parents with the sorted list of their children's values; none gives an empty list."""
    lists = children.groupBy(F.col(child_key).alias("__id")).agg(F.array_sort(F.collect_list(value)).alias(name))
    kind = children.schema[value].dataType.simpleString()
    return parents.join(lists, F.col(parent_key) == F.col("__id"), "left").drop("__id").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `number`, from 0, in an order that ends in a unique key.

    Ranges are numbered apart and moved by the rows of those before them, of which
    there are as many as partitions, so no task sees all rows.
    """
    from palimpsest.session import stored

    within = W.partitionBy("__part").orderBy(*order)
    ranged = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ranged.join(F.broadcast(before), "__part").withColumn("number", F.col("__before") + F.row_number().over(within) - 1).drop("__part", "__before")
