import pytest
from pyspark.sql import functions as F

from palimpsest.api import Memory
from palimpsest.sources.store import Catalogue, ConfigMismatch, Conflict, KeptCounts, Sessions, TableStore


def test_versions(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    assert not store.exists("t") and store.read("t", "a int").count() == 0
    with pytest.raises(KeyError):
        store.read("t")
    store.write("t", spark.range(3))
    store.change("t", lambda df: df.where("id > 0"))
    store.change("t", lambda df: df.where("id > 1"))
    assert store.versions("t") == [1, 2] and store.read("t").count() == 1
    (tmp_path / "s/t/v=9").mkdir()  # a writer that died
    assert store.read("t").count() == 1
    store.drop("t")
    assert not store.exists("t")


def test_catalogue(spark, tmp_path):
    found = Catalogue(TableStore(spark, f"file://{tmp_path}/s"), "collection")
    found.open_or_create("ns", "a", "cosine:64")
    assert found.open_or_create("ns", "a", "cosine:64") == found.open("ns", "a")
    for bad in (lambda: found.open_or_create("ns", "a", "dot:64"), lambda: found.create("ns", "a", "x")):
        with pytest.raises(ConfigMismatch):
            bad()
    found.delete("ns", "a")
    found.delete("ns", "a")
    with pytest.raises(KeyError):
        found.open("ns", "a")


def test_memory_and_sessions(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    memory, sessions = Memory(store), Sessions(store)
    rows = [("s1", f"message {k} about {'cats' if k == 3 else 'dogs'}", k, '{"k": %d}' % k) for k in range(6)] + [("s2", "cats cats cats", 9, None)]
    df = spark.createDataFrame(rows, "session_key string, content string, n int, metadata string").withColumn("created_at", F.timestamp_seconds("n"))
    memory.add(df)
    memory.add(df.where("n < 3"))
    assert memory.count() == 7 and memory.count("m.k >= 4") == 2 and memory.count("session = s2") == 1
    best = memory.search("cats", limit=1).first()
    assert best.content == "cats cats cats" and best["rank"] == 1
    around = memory.search("cats about message 3", limit=1, where="session = s1", expand=3).collect()
    assert [r.distance for r in around] == [-1, 0, 1, 2] and around[1].content == "message 3 about cats"
    assert [r.content[:9] for r in memory.list("session = s1", 2, 1).collect()] == ["message 2", "message 3"]
    memory.delete("m.k < 2")
    assert memory.count() == 5
    sessions.create("s1", metadata='{"team": "x"}')
    sessions.create("s2")
    with pytest.raises(ConfigMismatch):
        sessions.create("s1")
    assert [r.session_key for r in sessions.find("active", {"team": "x"}).collect()] == ["s1"]
    sessions.set_status("s1", "deleted")
    sessions.purge(["episodes"])
    assert memory.count() == 1 and sessions.rows().count() == 1


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_deletes(spark, tmp_path):
    """Merge on read: a delete takes what was there, by its column, and not what comes later."""
    store = TableStore(spark, f"file://{tmp_path}/s")
    rows = lambda *k: spark.createDataFrame([(x, x % 3) for x in k], "id long, g long")
    with pytest.raises(KeyError):
        store.delete("t", rows(1), "id")
    store.write("t", rows(1, 2, 3, 4))
    store.append("t", rows(5, 6))
    store.delete("t", rows(2, 5, 99), "id")
    store.append("t", rows(5, 7))
    assert ids(store.read("t")) == [1, 3, 4, 5, 6, 7]
    store.delete("t", spark.createDataFrame([(0,), (None,)], "k long"), "g")
    store.append("t", rows(9))
    store.delete("t", rows(1), "id")
    assert ids(store.read("t")) == [4, 5, 7, 9]
    assert store.versions("t") == [0] and len(list((tmp_path / "s/t").glob("gone=0/k=*/d=*"))) == 3
    store.compact("t")
    assert ids(store.read("t")) == [4, 5, 7, 9] and not store._deletes("t", 1)


def test_a_delete_that_was_stopped(spark, tmp_path):
    """A delete or part without its marker is not read, its number is not given again."""
    store = TableStore(spark, f"file://{tmp_path}/s")
    store.write("t", spark.range(5))
    store.delete("t", spark.range(2), "id")
    (tmp_path / "s/t/gone=0/k=id/d=1/_SUCCESS").unlink()
    assert ids(store.read("t")) == [0, 1, 2, 3, 4]
    store.append("t", spark.range(7, 8))
    assert ids(store.read("t")) == [0, 1, 2, 3, 4, 7] and store._next("t", 0) == 3


def test_drain_is_taken_up_again(spark, tmp_path):
    """A run that stops between children and parents, and between batches, loses and doubles nothing."""
    store = TableStore(spark, f"file://{tmp_path}/s")
    sessions = Sessions(store)
    for key in ("a", "b", "c"):
        sessions.create(key)
    sessions.set_status("a", "deleted")
    rows = [(f"{s}{k:02}", s) for s in "abc" for k in range(10)]
    store.write("episodes", spark.createDataFrame(rows, "uid string, session_key string"))
    store.write("links", spark.createDataFrame([(f"{u}-{n}", u) for u, _ in rows for n in range(2)], "id string, episode string"))
    assert sessions.drain("episodes", "uid", {"links": "episode"}, batch=4, most=1) == 1
    assert store.read("episodes").count() == 26 and store.read("links").count() == 52
    assert sessions.rows().count() == 3
    # children of the next batch are gone, their parents are not
    store.delete("links", spark.createDataFrame([("a04",), ("a05",)], "k string"), "episode")
    assert Sessions(TableStore(spark, store.root)).drain("episodes", "uid", {"links": "episode"}, batch=4) == 2
    assert store.read("episodes").count() == 20 and store.read("links").count() == 40
    assert sorted(r.session_key for r in sessions.rows().collect()) == ["b", "c"]
    assert sessions.drain("episodes", "uid", {}, 4) == 0


def test_kept_counts(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    counts = KeptCounts(store, "t", "g")
    rows = lambda *k: spark.createDataFrame([(x, f"g{x % 3}") for x in k], "id long, g string")
    fresh = lambda: {r.g: r.n for r in store.read("t").groupBy("g").agg(F.count("*").alias("n")).collect()}
    kept = lambda: {r.g: r.n for r in counts.read().collect()}
    store.write("t", rows(*range(10)))
    assert kept() == fresh() and counts.of("g0") == 4 and counts.of("none") == 0
    store.append("t", rows(10, 11, 12))
    store.delete("t", rows(0).select("g"), "g")
    store.append("t", rows(15))
    assert kept() == fresh() == {"g0": 1, "g1": 4, "g2": 4}
    # what was counted is not read again
    plan = counts.read()._jdf.queryExecution().toString()
    assert "/counts=0/" in plan and "/v=0" not in plan and "/parts=0" not in plan
    store.delete("t", rows(1), "id")
    assert counts.refresh() is None and kept() == fresh()
    store.compact("t")
    assert kept() == fresh() and counts.refresh() == 1


def test_change_of_several_tables(spark, tmp_path):
    """All or none: a step that fails at plan or at run time, a writer that dies, and one that comes between."""
    store = TableStore(spark, f"file://{tmp_path}/s")
    for name in "abc":
        store.write(name, spark.range(3))
    more = lambda df: df.select((F.col("id") + 10).alias("id"))
    bad = lambda df: df.select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    state = lambda: [ids(store.read(name)) for name in "abc"]
    for step in (bad, lambda df: df.select("none")):
        with pytest.raises(Exception):
            store.change_all({"a": more, "b": more, "c": step})
        assert state() == [[0, 1, 2]] * 3 and [store.versions(n) for n in "abc"] == [[0]] * 3
    with pytest.raises(KeyError):
        store.change_all({"a": more, "none": more})
    store.change_all({"a": more, "b": more})
    assert state() == [[10, 11, 12], [10, 11, 12], [0, 1, 2]]
    # a writer that died before its commit: nothing is seen, and after recover() the table can be changed again
    store._claim("a", 2)
    store._make(f"{store.root}/a/pending/2-dead")
    spark.range(1).write.parquet(f"{store.root}/a/v=2")
    assert ids(store.read("a")) == [10, 11, 12]
    with pytest.raises(Conflict):
        store.change_all({"a": more, "c": more})
    assert ids(store.read("c")) == [0, 1, 2]
    store.recover("a")
    store.change_all({"a": more, "c": more})
    assert state() == [[20, 21, 22], [10, 11, 12], [10, 11, 12]]


def test_names_and_cascade(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    found = Catalogue(store, "partition")
    for bad in ("A", "a-b", "", "x" * 33, "a\n"):
        with pytest.raises(ValueError):
            found.create("ns", bad, "x")
    found.create("ns", "p1", "x")
    store.write("segments", spark.createDataFrame([("p1", 1), ("p2", 2)], "partition_key string, id long"))
    found.delete("ns", "p1", {"segments": "partition_key", "links": "partition_key"})
    assert ids(store.read("segments")) == [2] and found.config("ns", "p1") is None
