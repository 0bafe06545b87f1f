"""Semantic ingestion: a micro-batch of each due set becomes features; cluster state and guarded splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import ids as I

from . import clusters as K
from . import features as P

COMMANDS = "array<struct<command:string,tag:string,feature:string,value:string>>"


def process_sets(history: DataFrame, episodes: DataFrame, features: DataFrame, citations: DataFrame, sets: DataFrame, extract: Callable[[str], list[tuple[str, str, str, str]]], most: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, features, citations) after a micro-batch of the given sets.

    Of each set the first `most` pending rows are taken by history id; those whose
    episode (uid, content) is missing leave the history; of the others `extract`
    gives commands (add or delete, tag, feature, value), which apply in the order
    of the ids; an added feature cites its message; the rows are marked ingested.
    features(id, set_id, tag, feature, value): ids of added ones are hashes of set,
    message and place, so that a replay gives them again.
    """

    @F.pandas_udf(COMMANDS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: [dict(zip(("command", "tag", "feature", "value"), c)) for c in extract(t or "")])

    batch = P.next_batch(history, sets, most)
    known, missing = P.known_and_missing(batch.select("set_id", "history_id", "position"), episodes.select("uid", "content"))
    rows = known.select("set_id", "history_id", "position", F.posexplode(run("content")).alias("n", "c")).select("set_id", "history_id", (F.col("position") * 1_000_000 + F.col("n")).cast("long").alias("seq"), "c.*")
    named = rows.withColumn("id", F.sha2(F.concat_ws("|", "set_id", "history_id", F.col("seq").cast("string")), 256))
    log = named.select("set_id", "tag", "feature", "seq", "command", "value", "id")
    left = P.apply_commands(features.select("set_id", "tag", "feature", "value", "id"), log, ["set_id", "tag", "feature"]).select("id", "set_id", "tag", "feature", "value")
    cited = named.where("command = 'add'").select(F.col("id").alias("feature_id"), "history_id")
    kept = P.add_citations(citations, cited).join(left.select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
    after = history.join(missing.select("set_id", "history_id"), ["set_id", "history_id"], "left_anti")
    return P.mark_ingested(after, known), left, kept.select(*citations.columns)


def save_state(state: DataFrame, new: DataFrame, key: str = "set_id") -> DataFrame:
    """A table of state in which the sets of `new` are replaced whole."""
    return state.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def load_state(state: DataFrame, sets: DataFrame, key: str = "set_id") -> DataFrame:
    """The state of the given sets (first column)."""
    return state.join(sets.toDF(key).distinct(), key, "left_semi")


def delete_state(state: DataFrame, sets: DataFrame, key: str = "set_id") -> DataFrame:
    """The state without the given sets (first column)."""
    return state.join(sets.toDF(key).distinct(), key, "left_anti")


def guarded_split(events: DataFrame, saved: DataFrame, cluster: str, event: str, order: list[str], **rule) -> DataFrame:
    """cluster, event, input_hash, segment, child: clusters split, or their saved split where its input is the same.

    saved(cluster, event, input_hash, segment). input_hash is that of the cluster's
    event ids, so a replay gives what was decided, and a changed cluster is split anew.
    """
    hashes = events.groupBy(cluster).agg(I.input_hash(F.array_sort(F.collect_list(F.col(event).cast("string")))).alias("input_hash"))
    same = hashes.join(saved.select(cluster, "input_hash").distinct(), [cluster, "input_hash"], "left_semi")
    replayed = saved.join(same, [cluster, "input_hash"], "left_semi").select(cluster, event, "input_hash", F.col("segment").cast("long").alias("segment"))
    changed = events.join(same.select(cluster), cluster, "left_anti")
    split = K.split_segments(K.adjacent(changed, [cluster], order), [cluster], order, **rule).join(hashes, cluster)
    whole = replayed.unionByName(split.select(cluster, event, "input_hash", F.col("segment").cast("long").alias("segment")))
    return whole.withColumn("child", I.child_id(F.col(cluster).cast("string"), F.col("segment")))
