"""Structured Streaming: ingestion, exactly-once history, triggers, command logs and online clusters.

Each function starts a query and returns it; `drain` runs one over what is
there. Writes of a batch are replayable: a batch writes to a folder of its own
number, overwriting what an earlier attempt left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.clusters import Clusters


def files(spark: SparkSession, path: str, schema, per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Runs a query over all that is there now, and waits for it."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def into_batches(stream: DataFrame, path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataStreamWriter:
    """A writer of shape(batch) into one folder per batch number."""

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).drop("batch")


def once(stream: DataFrame, key: list[str], time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each key once. Without a time state is kept for ever, as late rows are never refused; with one, for the delay."""
    if time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def messages_to_rows(stream: DataFrame) -> DataFrame:
    """Messages as episode rows: defaults filled in, an id that a replay gives again."""
    return stream.select(
        F.sha2(F.concat_ws("|", "session_key", "producer_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "content"), 256).alias("uid"),
        "session_key",
        F.coalesce("producer_id", F.lit("user")).alias("producer_id"),
        F.coalesce("producer_role", F.lit("user")).alias("producer_role"),
        F.coalesce("content", F.lit("")).alias("content"),
        "created_at",
    )


def due_sets(stream: DataFrame, least: int, on_due: Callable[[DataFrame, int], None], history: Callable[[], DataFrame], older_than) -> DataStreamWriter:
    """Per batch, hands on the sets that are due (enough pending rows, or one pending too long) of the history as it is then."""
    from palimpsest.operators.features import dirty_sets

    def run(batch: DataFrame, number: int) -> None:
        touched = batch.select("set_id").distinct()
        on_due(dirty_sets(history().join(touched, "set_id", "left_semi"), least, older_than), number)

    return stream.writeStream.foreachBatch(run)


def online_clusters(stream: DataFrame, threshold: float = 0.3) -> DataFrame:
    """set_id, event_id, cluster of a stream (set_id, event_id, ts, embedding), clusters kept as state per set; events of a batch in order of time."""
    state_schema = "centroids array<array<double>>, counts array<int>, last array<double>, assigned map<string,int>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        kept = Clusters(threshold)
        if state.exists:
            centroids, counts, last, assigned = state.get
            kept.centroids, kept.counts, kept.last, kept.assigned = [np.array(c) for c in centroids], list(counts), list(last), dict(assigned)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = [kept.assign(str(e), v, t.timestamp()) for e, v, t in zip(rows.event_id, rows.embedding, rows.ts)]
        state.update(([c.tolist() for c in kept.centroids], kept.counts, kept.last, kept.assigned))
        yield pd.DataFrame({"set_id": rows.set_id, "event_id": rows.event_id, "cluster": out})

    return stream.groupBy("set_id").applyInPandasWithState(step, "set_id long, event_id long, cluster int", state_schema, "append", GroupStateTimeout.NoTimeout)


def short_term_state(stream: DataFrame, capacity: int) -> DataFrame:
    """session_key, sequence_num, summarised of a stream (session_key, sequence_num, content): how many of a session's messages have gone to its summary after each message.

    The state of a session is the lengths of the messages that still fit and the
    number of those that do not; messages of a batch count in the order of their
    numbers, so results do not depend on how the stream is cut into batches.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gone, lengths = state.get if state.exists else (0, [])
        lengths = list(lengths)
        rows = sorted((int(n), len(text or "")) for frame in frames for n, text in zip(frame.sequence_num, frame.content))
        out, used = [], sum(lengths)
        for _, length in rows:
            lengths.append(length)
            used += length
            while lengths and used > capacity:
                used -= lengths.pop(0)
                gone += 1
            out.append(gone)
        state.update((gone, lengths))
        yield pd.DataFrame({"session_key": [key[0]] * len(rows), "sequence_num": [n for n, _ in rows], "summarised": out})

    return stream.groupBy("session_key").applyInPandasWithState(step, "session_key long, sequence_num long, summarised long", "gone long, lengths array<long>", "append", GroupStateTimeout.NoTimeout)


def session_windows(stream: DataFrame, time: str, gap: str, key: list[str], delay: str = "1 day") -> DataFrame:
    """Sessions by a time gap (an extension: the watermark is this library's choice)."""
    return stream.withWatermark(time, delay).groupBy(*key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
