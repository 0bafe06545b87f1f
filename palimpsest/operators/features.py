"""The feature store: features(id, set_id, category, tag, feature, value, ...), citations(feature_id, history_id), history(set_id, history_id, created_at, ingested)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


from . import search as S
from .tables import insert_missing, page, patch, without_ids


def feature_page(features: DataFrame, size: int | None, number: int | None = None, tag_threshold: int | None = None) -> DataFrame:
    """A page by (created_at, id); then, of that page only, rows whose tag is there often enough."""
    found = page(features, [F.col("created_at"), F.col("id")], size, number)
    if not tag_threshold:
        return found
    return found.withColumn("__n", F.count("*").over(W.partitionBy("tag"))).where(F.col("__n") >= tag_threshold).drop("__n")


def grouped(features: DataFrame, keys: list[str]) -> DataFrame:
    """Number of features and their ids, sorted, by group."""
    return features.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def profile(features: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per (by, tag, feature) with the value that came last."""
    return features.groupBy(*by, "tag", "feature").agg(F.max_by("value", F.struct(*order)).alias("value"))


def profile_json(features: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by and profile, a map tag -> (feature -> value)."""
    inner = profile(features, by, order).groupBy(*by, "tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("found"))
    return inner.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", F.to_json("found").alias("json"))))).alias("profile"))


def sections(features: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """Groups of at least so many features, as the JSON list that a consolidation gets."""
    item = F.struct("tag", "feature", "value", F.struct(F.col("id")).alias("metadata"))
    return features.groupBy(*keys).agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(item))).alias("items")).where(F.col("n") >= least)


def merged_citations(features: DataFrame, citations: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sorted citations of the features of each group."""
    joined = features.select(*keys, "id").join(citations, F.col("id") == F.col("feature_id"), "left")
    return joined.groupBy(*keys).agg(F.array_sort(F.collect_set("history_id")).alias("citations"))


def pending_sets(history: DataFrame, least: int | None = None) -> DataFrame:
    """Sets with at least so many rows not ingested; none or 0 asks for all sets."""
    if not least or least <= 0:
        return history.select("set_id").distinct()
    return history.where("NOT ingested").groupBy("set_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("set_id")


def old_sets(history: DataFrame, older_than: Column) -> DataFrame:
    """Sets with a row not ingested from before a time."""
    return history.where((~F.col("ingested")) & (F.col("created_at") <= older_than)).select("set_id").distinct()


def dirty_sets(history: DataFrame, least: int | None, older_than: Column | None) -> DataFrame:
    """Sets that are due: enough rows pending, or one pending for too long; without any condition all sets."""
    parts = ([pending_sets(history, least)] if least and least > 0 else []) + ([old_sets(history, older_than)] if older_than is not None else [])
    if not parts:
        return pending_sets(history)
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()


def purgeable(history: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Ingested rows of sets (those given, by the first column) that have nothing pending; the rest of the history is its left_anti."""
    history = history if sets is None else history.join(sets.toDF("set_id").distinct(), "set_id", "left_semi")
    open_sets = history.where("NOT ingested").select("set_id").distinct()
    return history.where("ingested").join(open_sets, "set_id", "left_anti")


def sets_with_prefix(history: DataFrame, features: DataFrame, prefix: str) -> DataFrame:
    starts = F.col("set_id").startswith(prefix)
    return history.where(starts).select("set_id").union(features.where(starts).select("set_id")).distinct()


def mark_ingested(history: DataFrame, done: DataFrame) -> DataFrame:
    """The history with the given (set_id, history_id) rows marked."""
    marks = done.select("set_id", "history_id").distinct().withColumn("__done", F.lit(True))
    return history.join(marks, ["set_id", "history_id"], "left").withColumn("ingested", F.col("ingested") | F.coalesce("__done", F.lit(False))).drop("__done")


def apply_commands(features: DataFrame, commands: DataFrame, key: list[str]) -> DataFrame:
    """What features are left after a log of add and delete commands (seq, command, key, value).

    A delete removes everything of its key before it; adds after the last delete stay, in their order.
    """
    last = commands.where("command = 'delete'").groupBy(*key).agg(F.max("seq").alias("__last"))
    log = features.withColumn("seq", F.lit(-1).cast("long")).unionByName(commands.where("command = 'add'").drop("command"))
    return log.join(last, key, "left").where(F.col("__last").isNull() | (F.col("seq") > F.col("__last"))).drop("__last")


def add_citations(citations: DataFrame, new: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """The citations (feature_id, history_id) with new ones, each once; with features, new ones of ids that are not there are left out."""
    if features is not None:
        new = new.join(features.select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
    return citations.unionByName(new).distinct()


def history_count(history: DataFrame, sets: DataFrame | None = None, ingested: bool | None = None) -> DataFrame:
    """n: number of history rows, of the given sets (first column) and with the given mark."""
    found = history if sets is None else history.join(sets.toDF("set_id").distinct(), "set_id", "left_semi")
    found = found if ingested is None else found.where(F.col("ingested") == ingested)
    return found.agg(F.count("*").alias("n"))


def add_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """The history with new (set_id, history_id, created_at) rows, not ingested; rows that are there stay."""
    fresh = new.dropDuplicates(["set_id", "history_id"]).withColumn("ingested", F.lit(False)).join(history, ["set_id", "history_id"], "left_anti")
    return history.unionByName(fresh)


def delete_history(history: DataFrame, citations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History and citations without the given history ids (first column)."""
    return without_ids(history, ids, "history_id"), without_ids(citations, ids, "history_id")


def delete_history_sets(history: DataFrame, sets: DataFrame) -> DataFrame:
    """The history without the given sets (first column)."""
    return without_ids(history, sets, "set_id")


def feature_search(queries: DataFrame, vectors: DataFrame, features: DataFrame, size: int, number: int = 0, threshold: float | None = None, where: Column | None = None, metric: str | None = None) -> DataFrame:
    """A page of each query's features by the score of their vectors, with columns of the features; position from 0.

    vectors(id, embedding), features(id, ...). The filter comes after the vector
    search in meaning, so it takes rows out of the ranking; all vectors are candidates.
    """
    given = features if where is None else features.where(where)
    candidates = vectors.select("id", "embedding").join(given.select("id"), "id", "left_semi")
    best = S.knn(queries, candidates, size * (number + 1), metric, threshold, tie="id").where(F.col("rank") > size * number)
    return best.select("query_id", "id", "score", (F.col("rank") - 1).alias("position")).join(given, "id")


def insert_features(features: DataFrame, new: DataFrame) -> DataFrame:
    """Features with new ones; an id that is there stays as it is, columns a new one does not have are null."""
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in features.schema if f.name not in new.columns]
    return insert_missing(features, new.select("*", *lacking).select(*features.columns), ["id"])


def update_features(features: DataFrame, changes: DataFrame) -> DataFrame:
    """Features with the non-null columns of the changes for their ids."""
    return patch(features, changes, "id", [c for c in changes.columns if c != "id"])


def delete_features(features: DataFrame, citations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, citations) without the given ids (first column) and what they cite."""
    return without_ids(features, ids, "id"), without_ids(citations, ids, "feature_id")


def consolidated(features: DataFrame, citations: DataFrame, replies: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, citations) after consolidation of groups of features.

    replies(*keys, keep array of ids, merged array of struct(id, feature, value)): of a
    group with a reply the features that it does not keep go, with their
    citations; merged ones come, with the group's keys, and cite all that those
    that went did. A null keep changes nothing. Merged tags are the group's own.
    """
    sound = replies.where(F.col("keep").isNotNull())
    grouped = features.join(sound.select(*keys, "keep"), keys, "left")
    gone = grouped.where(F.col("keep").isNotNull() & ~F.array_contains("keep", F.col("id"))).select(*keys, "id")
    added = sound.select(*keys, F.explode("merged").alias("m")).select(*keys, "m.*")
    others = [c for c in features.columns if c not in added.columns]
    left = features.join(gone.select("id"), "id", "left_anti").select(*features.columns)
    new = added.select(*added.columns, *[F.lit(None).cast(features.schema[c].dataType).alias(c) for c in others])
    cited = gone.join(citations, F.col("id") == F.col("feature_id")).select(*keys, "history_id").distinct()
    passed_on = added.select(*keys, F.col("id").alias("feature_id")).join(cited, keys).select("feature_id", "history_id")
    kept = citations.join(gone.select(F.col("id").alias("feature_id")), "feature_id", "left_anti").select(*citations.columns)
    return left.unionByName(new.select(*features.columns)), kept.unionByName(passed_on)


def next_batch(history: DataFrame, sets: DataFrame, most: int = 5) -> DataFrame:
    """Of each given set (first column) the first `most` rows that are not ingested, by id."""
    pending = history.where("NOT ingested").join(sets.toDF("set_id").distinct(), "set_id", "left_semi")
    order = W.partitionBy("set_id").orderBy("history_id")
    return pending.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def known_and_missing(batch: DataFrame, episodes: DataFrame, uid: str = "uid") -> tuple[DataFrame, DataFrame]:
    """Of a batch the rows whose episode is there, with its columns, and those whose is not: they leave the history."""
    there = episodes.withColumnRenamed(uid, "history_id")
    return batch.join(there, "history_id"), batch.join(there.select("history_id"), "history_id", "left_anti")
