"""Stateful processors with a clock set by hand, and their streams against plain folds."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.catalogue.streams import _in_turn
from palimpsest.operators import clusters
from palimpsest.streaming import ingest, stateful


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Listed(Value):
    def get(self):
        return iter(self.v or [])

    def put(self, v):
        self.v = list(v)


class Mapped(dict):
    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.timers = set()

    def getMapState(self, *_, **__):
        return Mapped()

    def getValueState(self, *_, **__):
        return Value()

    def getListState(self, *_, **__):
        return Listed()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return list(self.timers)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


class Driven:
    """A DueSets processor of one set, moved by hand."""

    def __init__(self, *args):
        self.handle, self.processor = Handle(), stateful.DueSets(*args)
        self.processor.init(self.handle)

    def rows(self, now, *rows):
        frame = pd.DataFrame(rows, columns=["history_id", "at_ms", "ingested"])
        return self._told(self.processor.handleInputRows(("s",), iter([frame]), Clock(now)))

    def until(self, now):
        """What timers say up to a time."""
        found = []
        while due := [t for t in self.handle.timers if t <= now]:
            at = min(due)
            self.handle.timers.discard(at)
            found += self._told(self.processor.handleExpiredTimer(("s",), Clock(at), Expired(at)))
        return found

    def _told(self, frames):
        return [(r.reason, r.pending, r.at_ms) for f in frames for r in f.itertuples()]


def test_due_by_age_without_a_new_row():
    s = Driven(3, 1000, None, False)
    assert s.rows(10, ("a", 10, False)) == [] and s.until(1009) == []
    assert s.until(5000) == [("age", 1, 1010)] and s.until(99_999) == []
    assert s.rows(5000, ("a", 10, True)) == [] and not s.handle.timers
    assert s.rows(6000, ("b", 5900, False)) == [] and s.until(9000) == [("age", 1, 6900)]


def test_due_by_count_and_taken_back():
    s = Driven(3, 1000, None, False)
    assert s.rows(10, ("a", 10, False), ("b", 10, False), ("c", 12, True)) == []
    assert s.rows(20, ("c", 20, False)) == [("count", 3, 20)]
    assert s.rows(25, ("d", 25, False)) == []
    assert s.rows(30, *[(x, 0, True) for x in "abcd"]) == [] and s.until(9999) == []
    assert s.rows(40, *[(x, 40, False) for x in "efg"]) == [("count", 3, 40)]


def test_pauses_double_while_it_fails():
    s = Driven(1, 10**9, 2000, False)
    assert s.rows(0, ("a", 0, False)) == [("count", 1, 0)]
    times = [at for _, _, at in s.until(400_000)]
    assert times[:6] == [2000, 6000, 14_000, 30_000, 62_000, 122_000] and set(b - a for a, b in zip(times[5:], times[6:])) == {60_000}
    assert s.rows(400_001, ("a", 0, True)) == [] and s.until(10**7) == []
    assert s.rows(10**7, ("b", 10**7, False)) == [("count", 1, 10**7)] and s.until(10**7 + 2000) == [("count", 1, 10**7 + 2000)]


def test_rows_without_a_time_do_not_age():
    s = Driven(3, 1000, None, False)
    assert s.rows(10, ("a", None, False)) == [] and s.until(10**15) == []
    assert s.rows(20, ("b", 20, False)) == [] and s.until(10**15) == [("age", 2, 1020)]


def test_summaries_halve_and_wait():
    """A model with a short context gets halves, at last halves of a text; one that fails keeps the queue; repeated rows do not count."""
    given = []

    def model(summary, texts):
        given.append(list(texts))
        if sum(map(len, texts)) > 6:
            raise stateful.TooLong("too long")
        return summary + "".join(texts)

    assert stateful.summarised("", ["ab", "cdefghijk", "l", "mn"], model) == "abcdefghijklmn"
    assert max(len("".join(t)) for t in given if len(t) > 1) > 6 and ["cdef"] in given
    assert stateful.summarised("x", [], model) == "x" and stateful.summarised("x", ["a"], lambda s, t: "") == "x"
    with pytest.raises(stateful.TooLong):
        stateful.summarised("", ["ab"], lambda s, t: (_ for _ in ()).throw(stateful.TooLong("no")))

    broken = [True]

    def fails(summary, texts):
        if broken[0]:
            raise RuntimeError("down")
        return summary + "".join(texts)

    processor = stateful.Summaries(4, fails)
    processor.init(Handle())
    run = lambda *rows: next(iter(processor.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["sequence_num", "content"])]), None))).iloc[0]
    first = run((1, "aaa"), (2, "bb"), (3, None))
    assert (first.summarised, first.waiting, first.summary, first.error) == (0, 1, "", "down")
    assert run((2, "bb"), (1, "aaa")).waiting == 1
    broken[0] = False
    last = run((5, "dddd"), (4, "cc"))
    assert (last.summary, last.summarised, last.waiting, last.sequence_num) == ("aaabbcc", 4, 0, 5)


def events(spark, n=80):
    rows = [(k % 2, k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=7 * k), [float((k * 7) % 5 - 2), float((k * 3) % 4 - 1), 1.0]) for k in range(n)]
    return spark.createDataFrame(rows, "set_id long, event_id long, ts timestamp, embedding array<double>")


@pytest.mark.parametrize("max_gap", [None, 1500.0])
def test_clusters_go_on_from_saved_state(spark, tmp_path, max_gap):
    """Half in batch, half streamed from the saved state, with a batch delivered twice, equals the fold of all."""
    df = events(spark)
    early, late = df.where("event_id < 40"), df.where("event_id >= 40").withColumn("part", (F.col("event_id") >= 60).cast("int"))
    again = late.union(late.where("part = 0").withColumn("part", F.lit(1)))
    state = clusters.online_state(early, "set_id", "event_id", 0.8, max_gap)
    stream = stateful.online_clusters(_in_turn(again, "part", 2), 0.8, max_gap, state)
    stateful.drain(spark, ingest.into_batches(stream, f"{tmp_path}/out"), f"{tmp_path}/state")
    streamed = {tuple(r) for r in ingest.read_batches(spark, f"{tmp_path}/out", "set_id long, event_id long, cluster int").collect()}
    wanted = {tuple(r) for r in clusters.online(df, "set_id", "event_id", 0.8, max_gap).collect()}
    assert streamed == {r for r in wanted if r[1] >= 40} and len({r[2] for r in wanted}) > 2


def test_resumed_query_equals_the_fold(spark):
    from palimpsest import catalogue

    rows = lambda name: {(int(r.label), r.uid, r.cluster) for r in catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()}
    assert rows("stream_clusters_resumed") == rows("cluster_online")
