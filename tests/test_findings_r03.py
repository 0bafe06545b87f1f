"""What the review of round 3 found."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import catalogue
from palimpsest.operators import agents, blocks, search, sets

from .compare import TABLES, compared, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of the small tables in which some can be others."""

    def make(**changed):
        for t in TABLES:
            (tmp_path / f"{t}.parquet").symlink_to(changed.get(t, f"{SMALL}/{t}.parquet"))
        return str(tmp_path)

    return make


def _checked(spark, folder, name):
    assert compared(spark, duck(folder), folder, catalogue.queries()[name], catalogue.oracle_sql()[name]) is None


def test_all_pairs_of_many_queries(spark, monkeypatch):
    """a result of all pairs does not depend on the number of queries."""
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)], "uid long, embedding array<float>")
    queries = df.select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = search.scored(queries, df, metric="l2").collect()
    assert sorted((r.query_id, r.uid, r.score) for r in rows) == [(a, b, float(abs(a - b))) for a in range(10) for b in range(10)]


def test_seeds_tie_by_rounded_scores(spark):
    """of scores that are equal when rounded the least seed is first."""
    hits = spark.createDataFrame([(0, 7, 0.50000012), (0, 9, 0.50000021), (0, 9, 0.1), (0, 8, 0.6)], "query_id long, label long, score double")
    found = search.best_per_seed(hits, "label", digits=6).orderBy("seed_rank").collect()
    assert [(r.label, r.score) for r in found] == [(8, 0.6), (7, 0.5), (9, 0.5)]
    assert [r.label for r in search.best_per_seed(hits, "label").orderBy("seed_rank").collect()] == [8, 9, 7]


@pytest.mark.parametrize("name", ["event_search", "declarative_search", "vec_best_per_seed", "ltm_declarative_search"])
def test_searches_with_close_scores(spark, tables, tmp_path_factory, name):
    """Vectors whose scores differ beyond the sixth digit only."""
    path = str(tmp_path_factory.mktemp("close") / "embeddings.parquet")
    rows = [(k, [1.0, (200 - k) * 1e-9 + (k % 20) * 0.1, 0.5 if k % 3 else 0.5 + k * 1e-8], k * 7 % 10) for k in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(path)
    (part,) = Path(path).glob("*.parquet")
    _checked(spark, tables(embeddings=str(part)), name)


def test_features_with_great_ids(spark, tables, tmp_path_factory):
    """ids that new features get are taken already."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SMALL}/events.parquet").where("event_id < 500")
    events.union(events.withColumn("event_id", F.col("event_id") + 1_000_000)).coalesce(1).write.parquet(f"{path}/e")
    (part,) = Path(f"{path}/e").glob("*.parquet")
    _checked(spark, tables(events=str(part)), "feat_one")


@pytest.mark.parametrize("name", ["agent_split_query", "agent_select_tool", "agent_chain_of_queries"])
def test_tools_find_every_turn(spark, tables, tmp_path_factory, name):
    """over 20 turns begin with one word."""
    path = str(tmp_path_factory.mktemp("turns"))
    rows = [(c, t, "user", f"{'the' if (c + t) % 3 else f'w{c}'} cat") for c in range(40) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/c")
    (part,) = Path(f"{path}/c").glob("*.parquet")
    folder = tables(conversations=str(part))
    _checked(spark, folder, name)
    assert catalogue.queries()[name](spark, folder).agg(F.max("n")).first()[0] >= 80


def test_totals_of_key(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 4), ("b", 8)], "word string, uid long")
    queries = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "query_id long, query_text string")
    found = agents.totals_of_key(rows, "word", F.col("query_text"), F.count("*").alias("n"), F.sum("uid").alias("uids"))(queries)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 3)]


def test_a_block_holds_no_more_than_its_result(monkeypatch):
    """Of many parts a block gives k rows a query, and pairs are scored in slices."""
    monkeypatch.setattr(blocks, "CELLS", 64)
    most, exact = [], blocks.exact
    monkeypatch.setattr(blocks, "exact", lambda q, c, metric: most.append(len(q)) or exact(q, c, metric))
    rows = np.array([[1.0, k / 100] for k in range(100)][::-1])
    found = blocks.Best(np.array([[1.0, 0.0], [0.0, 1.0]]), 5, "cosine").add(rows, np.arange(100))
    assert [sorted(found["at"][found.q == q]) for q in (0, 1)] == [[95, 96, 97, 98, 99], [0, 1, 2, 3, 4]]
    assert max(most) <= 64 // 4 // 2


def test_queries_go_once_to_a_bundle(spark, tmp_path, monkeypatch):
    """where all lists are looked into, rows that a query meets are dealt by bundles and not by lists."""
    from palimpsest.sources import vector_index

    monkeypatch.setattr(search, "CANDIDATE_BLOCKS", 2)
    df = spark.createDataFrame([(k, [float(k % 17), float(k % 5), 1.0], k % 3) for k in range(200)], "uid long, embedding array<double>, label int")
    index = vector_index.VectorIndex.create(df, str(tmp_path / "index"), lists=20)
    queries = df.where("uid < 10").select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))
    best = []
    monkeypatch.setattr(vector_index.S, "ranked", lambda hits, *_: best.append(hits) or hits)
    index.shortlist(queries, 4, probes=20)
    assert best[0].count() <= 10 * 2 * 4


@pytest.mark.parametrize("kind", ["due", "summaries"])
def test_state_calls_do_not_grow_with_rows(kind):
    """a batch of many rows of a key takes as many calls to its state as one of few."""
    import pandas as pd

    from palimpsest.streaming import stateful

    from . import test_stateful

    calls = []

    class Counted:
        def __init__(self, state):
            self.state = state

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.state, name)

    class Handle(test_stateful.Handle):
        getMapState = lambda self, *_, **__: Counted(test_stateful.Mapped())
        getValueState = lambda self, *_, **__: Counted(test_stateful.Value())
        getListState = lambda self, *_, **__: Counted(test_stateful.Listed())

    if kind == "due":
        processor, rows = stateful.DueSets(1000, 1000, None, False), pd.DataFrame({"history_id": [str(k) for k in range(100)], "at_ms": 5, "ingested": False})
    else:
        processor, rows = stateful.Summaries(10, lambda summary, texts: summary + "".join(texts)), pd.DataFrame({"sequence_num": range(100), "content": "abc"})
    processor.init(Handle())
    list(processor.handleInputRows(("s",), iter([rows]), test_stateful.Clock(10)))
    assert len(calls) <= (6 if kind == "due" else 2)


def test_windows_stream_in_parts(spark, monkeypatch):
    """a batch of the session windows sorts a part of the events."""
    from palimpsest.catalogue import streams

    shares, in_turn = [], streams._in_turn

    def counted(df, part, parts):
        n = [r["count"] for r in df.groupBy(part).count().collect()]
        shares.append(max(n) / sum(n))
        return in_turn(df, part, parts)

    monkeypatch.setattr(streams, "_in_turn", counted)
    assert streams.QUERIES["stream_session_windows"][0](spark, SMALL).count() > 0
    assert shares[0] < 0.3


def test_entries_of_a_common_tag_are_dealt(spark, monkeypatch):
    """types are copied to the shares of a common tag, and each entry meets them once."""
    monkeypatch.setattr(sets, "SHARE", 7)
    entries = spark.createDataFrame([(k, ["org", "user"] if k % 2 else ["org"]) for k in range(100)], "uid long, keys array<string>")
    types = spark.createDataFrame([(1, ["org"]), (2, ["org", "user"]), (3, ["project"]), (4, [])], "type_id int, tags array<string>")
    found = sets.matching_types(entries, types)
    assert "Join Inner, ((tag" in found._jdf.queryExecution().analyzed().toString() and "share" in found._jdf.queryExecution().analyzed().toString()
    rows = sorted((r.uid, r.type_id) for r in found.collect())
    assert rows == sorted([(k, t) for k in range(100) for t in (1, 4)] + [(k, 2) for k in range(1, 100, 2)])
