"""Stateful streams with timers and initial state: sets due by age, clusters that start from saved state, summaries.

Each processor keeps its state in the RocksDB store of its key; `drain` runs such a
query over what is there. The rows of a key that arrive in one micro-batch are
ordered in the task of the key, so a batch (files per trigger) bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.clusters import Clusters

from . import ingest

CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(spark: SparkSession, writer: DataStreamWriter, checkpoint: str, idle: bool = False) -> StreamingQuery:
    """ingest.drain for the queries of this module, whose state lies in RocksDB.

    idle: batches without rows run as well, by which timers of the stream's clock fire.
    With timers of the machine's clock such batches never end, so a drain leaves them out.
    """
    wanted = CONF | {IDLE: str(idle).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return ingest.drain(writer, checkpoint)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


#: Time of a pending row without a time: it does not age.
NEVER = 1 << 61
#: Milliseconds of the longest pause between two attempts.
LONGEST_PAUSE = 60_000


class DueSets(StatefulProcessor):
    """Says when a set is due: enough rows pending, or one pending for too long, seen by a timer and not by a row.

    While a set stays due its turn comes again after a pause that doubles, as long as
    what handles it fails; rows that are reported ingested end that.
    """

    def __init__(self, least: int, limit_ms: int, pause_ms: int | None, event_time: bool):
        self.least, self.limit, self.pause, self.event_time = least, limit_ms, pause_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "history_id string, at long")
        self.turn = handle.getValueState("turn", "reason string, pause long, next long")

    def close(self) -> None:
        pass

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _timers(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def _pending(self) -> dict[str, int]:
        """Pending rows and their times. They are read and written whole: a call a row costs more than all else."""
        return dict(self.pending.get()) if self.pending.exists() else {}

    def _look(self, key: tuple, now: int, pending: dict[str, int]) -> list[tuple]:
        """What is due now, and the timer of what will be."""
        times = list(pending.values())
        if not times:
            self.turn.clear()
            self._timers(None)
            return []
        reason = "count" if len(times) >= self.least else "age" if min(times) + self.limit <= now else None
        before = self.turn.get() if self.turn.exists() else None
        if reason is None:
            self._timers(min(times) + self.limit)
            return []
        first = before is None or before[0] != reason
        if not first and (self.pause is None or now < before[2]):
            self._timers(min(times) + self.limit if reason == "count" and min(times) + self.limit > now else before[2] if self.pause is not None else None)
            return []
        pause = self.pause if first else min(2 * before[1], LONGEST_PAUSE)
        self.turn.update((reason, pause or 0, now + (pause or 0)))
        self._timers(now + pause if pause is not None else min(times) + self.limit if reason == "count" and min(times) + self.limit > now else None)
        return [(*key, reason, len(times), now)]

    def _rows(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame(found, columns=["set_id", "reason", "pending", "at_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._pending()
        pending = dict(before)
        for frame in rows:
            for history_id, at, ingested in zip(frame.history_id, frame.at_ms, frame.ingested):
                if not ingested:
                    pending[history_id] = NEVER if pd.isna(at) else int(at)
                else:
                    pending.pop(history_id, None)
        if pending != before:
            self.pending.put(list(pending.items())) if pending else self.pending.clear()
        yield from self._rows(self._look(key, self._now(timerValues), pending))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._rows(self._look(key, max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs()), self._pending()))


DUE = "set_id string, reason string, pending long, at_ms long"


def due_sets(stream: DataFrame, least: int, limit_seconds: float, pause_seconds: float | None = 2.0, clock: str = "processing") -> DataFrame:
    """set_id, reason (count or age), pending, at_ms of a stream (set_id, history_id, created_at, ingested) each time a set's turn comes.

    A history row with ingested = true takes back the pending row of its id. clock:
    `processing` is the machine's; `event` is the stream's watermark (set by the caller on
    created_at), so that a replay decides as the first run did. pause_seconds None: a
    turn is not repeated.
    """
    from pyspark.sql import functions as F

    given = stream.select("set_id", "history_id", F.unix_millis("created_at").alias("at_ms"), F.coalesce("ingested", F.lit(False)).alias("ingested"), "created_at")
    processor = DueSets(least, int(limit_seconds * 1000), None if pause_seconds is None else int(pause_seconds * 1000), clock == "event")
    return given.groupBy("set_id").transformWithStateInPandas(processor, DUE, "Append", "EventTime" if clock == "event" else "ProcessingTime")


class OnlineClusters(StatefulProcessor):
    """Clusters of one set; the events that were assigned are remembered for a time only, for what is delivered again."""

    def __init__(self, threshold: float, max_gap: float | None, remembered_ms: int | None):
        self.threshold, self.max_gap, self.remembered = threshold, max_gap, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getListState("clusters", "centroid array<double>, n long, last double")
        self.assigned = handle.getMapState("assigned", "event_id long", "cluster int", ttlDurationMs=self.remembered)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.clusters.put([(list(map(float, c)), int(n), float(t)) for c, n, t in zip(row["centroids"], row["counts"], row["last"])])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = Clusters(self.threshold, self.max_gap)
        if self.clusters.exists():
            for centroid, n, last in self.clusters.get():
                kept.centroids.append(np.array(centroid))
                kept.counts.append(int(n))
                kept.last.append(last)
        frame, out = _in_order(rows, ["ts", "event_id"]), []
        for event, vector, at in zip(frame.event_id, frame.embedding, frame.ts):
            known = (int(event),)
            if self.assigned.containsKey(known):
                out.append(int(self.assigned.getValue(known)[0]))
                continue
            out.append(kept.assign(int(event), vector, at.timestamp()))
            self.assigned.updateValue(known, (out[-1],))
        self.clusters.put([(c.tolist(), n, t) for c, n, t in zip(kept.centroids, kept.counts, kept.last)])
        yield pd.DataFrame({"set_id": key[0], "event_id": frame.event_id, "cluster": out})


def online_clusters(stream: DataFrame, threshold: float = 0.3, max_gap: float | None = None, initial: DataFrame | None = None, remembered_ms: int | None = 30 * 86_400_000) -> DataFrame:
    """set_id, event_id, cluster of a stream (set_id, event_id, ts, embedding), going on from saved clusters.

    initial(set_id, centroids, counts, last): the state that operators.clusters.online_state
    gives of a set's events so far; it is read once, when the query starts for the
    first time. An event that comes again within remembered_ms gets its cluster again.
    """
    start = None if initial is None else initial.select("set_id", "centroids", "counts", "last").groupBy("set_id")
    return stream.groupBy("set_id").transformWithStateInPandas(OnlineClusters(threshold, max_gap, remembered_ms), "set_id long, event_id long, cluster int", "Append", "ProcessingTime", initialState=start)


class TooLong(ValueError):
    """A model's context is too short for what it was given."""


def halved(texts: list[str]) -> list[list[str]]:
    """Two lists that hold the same text: a list's halves, or those of its only text. A text of one character cannot be halved."""
    if len(texts) > 1:
        return [texts[: len(texts) // 2], texts[len(texts) // 2 :]]
    if len(texts[0]) < 2:
        raise TooLong("a single character does not fit")
    return [[texts[0][: len(texts[0]) // 2]], [texts[0][len(texts[0]) // 2 :]]]


def summarised(summary: str, texts: list[str], model: Callable[[str, list[str]], str]) -> str:
    """The summary after the texts, in order; where the model says TooLong both halves are taken one after the other. An empty answer changes nothing."""
    waiting = [texts] if texts else []
    while waiting:
        part = waiting.pop()
        try:
            summary = model(summary, part) or summary
        except TooLong:
            waiting += halved(part)[::-1]
    return summary


class Summaries(StatefulProcessor):
    """Short-term memory of a session: what no longer fits waits in a queue, and a worker takes the queue into the summary.

    Where the model fails otherwise the queue stays as it is, for the session's next batch.
    """

    def __init__(self, capacity: int, model: Callable[[str, list[str]], str]):
        self.capacity, self.model = capacity, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, as each call to the store costs more than the rows of a session
        self.memory = handle.getValueState("memory", "text string, seen long, summarised long, kept array<string>, queue array<string>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, seen, done, kept, queue = self.memory.get() or ("", -(1 << 62), 0, [], [])
        kept, queue = list(kept), list(queue)
        frame = _in_order(rows, ["sequence_num"])
        used = sum(map(len, kept))
        for number, content in zip(frame.sequence_num, frame.content):
            if number <= seen:
                continue  # delivered again
            seen = int(number)
            kept.append(content or "")
            used += len(kept[-1])
            while kept and used > self.capacity:
                used -= len(kept[0])
                queue.append(kept.pop(0))
        error = None
        if queue:
            try:
                text, done, queue = summarised(text, queue, self.model), done + len(queue), []
            except Exception as failure:  # the queue waits
                error = str(failure)[:200]
        self.memory.update((text, seen, done, kept, queue))
        yield pd.DataFrame({"session_key": [key[0]], "sequence_num": [seen], "summarised": [done], "waiting": [len(queue)], "summary": [text], "error": pd.array([error], dtype="string")})


SUMMARY = "session_key long, sequence_num long, summarised long, waiting long, summary string, error string"


def summaries(stream: DataFrame, capacity: int, model: Callable[[str, list[str]], str]) -> DataFrame:
    """session_key, sequence_num (the last), summarised, waiting (messages), summary, error of a stream (session_key, sequence_num, content), per batch that has rows of the session.

    The newest messages of up to `capacity` characters stay, older ones go to
    model(summary, texts) in their order. Messages arrive in the order of their
    numbers from batch to batch; a number that was seen before is a repeated delivery.
    """
    return stream.groupBy("session_key").transformWithStateInPandas(Summaries(capacity, model), SUMMARY, "Append", "ProcessingTime")
