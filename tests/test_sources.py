"""SQLite source, time stamps of locales, set types and repeated new rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import timestamps
from palimpsest.operators import sets, tables
from palimpsest.plans.filters import compile_filter, parse_filter, resolver
from palimpsest.sources import sqlite


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(k // 2 if k % 50 else None, f"t{k % 7}" if k % 5 else None, k / 4, bytes([k % 256])) for k in range(1000)]
    df = spark.createDataFrame(rows, "key long, text string, value double, raw binary")
    sqlite.write_table(df.repartition(3), str(tmp_path / "db"), "t", "key")
    return df, str(tmp_path / "db")


def test_sqlite_round_trip(spark, folder):
    df, path = folder
    for options in ({}, {"page": 1}, {"page": 7, "partitions": 3}):
        found = sqlite.read_table(spark, f"file://{path}", "t", "key", **options)
        assert found.schema == df.schema and sorted(map(str, found.collect())) == sorted(map(str, df.collect()))


TEXTS = (
    "key > 100 AND key <= 200", "text = t3 OR key = 4", "text IN (t1, t2) AND value >= 20", "key IS NULL", "text IS NULL AND value < 30.5", "text > t4 AND key < 99", "NOT text = t1", "NOT (key = 3 OR text = t2)", "value != 3.5 AND NOT key IS NULL",
    "text > t4 OR key = 3", "key IN (1, 2, 9) OR text IS NULL",
)


@pytest.mark.parametrize("text", TEXTS)
def test_sqlite_filters(spark, folder, text):
    df, path = folder
    passes = compile_filter(parse_filter(text), resolver({c: c for c in df.columns}))
    assert sorted(map(str, sqlite.read_table(spark, path, "t", "key", text, page=50).collect())) == sorted(map(str, df.where(passes).collect()))


def test_sqlite_reads_what_passes_only(folder):
    """Rows that leave the source fall with what it takes of a filter; what it cannot decide stays with Spark."""
    df, path = folder
    kinds = {f.name: f.dataType for f in df.schema}

    def read(text):
        where = sqlite.pushed(parse_filter(text), kinds)
        reader = sqlite.SqliteReader(df.schema, {"path": path, "table": "t", "key": "key", "page": "20", "where": json.dumps(where or [])})
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p))

    assert read("key = 7") == 2 and read("key IS NULL") == 20
    assert read("key > 100 AND value <= 60.0 AND NOT text IS NULL") == df.where("key > 100 AND value <= 60 AND text IS NOT NULL").count()
    assert read("text IN (t1, t2)") == df.where("text IN ('t1', 't2')").count()
    assert read("text > t4 AND key < 99") == df.where("key < 99").count()
    for text in ("text > t4 OR key = 3", "NOT text > t4", "key = x", "other = 3"):
        assert read(text) == 1000


def test_sqlite_paths(tmp_path):
    assert str(sqlite.local("file:///a%20b/c")) == "/a b/c"
    with pytest.raises(ValueError):
        sqlite.local("hdfs://host/x")


def test_timestamps(spark):
    at = F.lit(datetime.datetime(2024, 3, 5, 15, 4, 9)).cast("timestamp")
    one = lambda *args: spark.range(1).select(timestamps.formatted(spark, at, *args)).first()[0]
    assert one() == "Tuesday, March 5, 2024 at 3:04:09 PM UTC"
    assert one("short", None) == "3/5/24" and one(None, "short") == "3:04 PM" and one(None, None) == ""
    assert one("short", "full") == "3/5/24 at 3:04:09 PM Coordinated Universal Time"
    assert one("full", "short", "de_DE", "America/New_York") == "Dienstag, 5. März 2024 um 10:04"
    assert one("medium", "short", "fr_FR", "Asia/Tokyo") == "6 mars 2024, 00:04"
    assert spark.range(1).select(timestamps.formatted(spark, F.lit(None).cast("timestamp"))).first()[0] is None
    with pytest.raises(ValueError):
        timestamps.pattern(spark, "tiny", None)


def test_types_without_tags(spark):
    """All of 1,500 types without tags match every entry, with and without keys."""
    types = spark.range(1500).select(F.col("id").alias("type_id"), F.array().cast("array<string>").alias("tags"))
    more = spark.createDataFrame([(5000, ["a"]), (5001, ["a", "b"]), (5002, [""])], "type_id long, tags array<string>")
    entries = spark.createDataFrame([(1, ["a"]), (2, []), (3, None), (4, ["", "b", "a"])], "uid long, keys array<string>")
    found = sets.matching_types(entries, types.union(more)).select("uid", "type_id").collect()
    assert len(found) == len(set(found)) == 4 * 1500 + 1 + 3
    assert {(r.uid, r.type_id) for r in found if r.type_id >= 5000} == {(1, 5000), (4, 5000), (4, 5001), (4, 5002)}


def test_new_rows_once_per_key(spark):
    old = spark.createDataFrame([(1, "a")], "set_id long, config string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (2, "y")], "set_id long, config string")
    for found in (sets.set_config(old, new), sets.set_config(old, new.repartition(3))):
        assert found.count() == 2 and found.where("set_id = 1").first().config == "x"
    assert tables.insert_missing(old, new, ["set_id"]).count() == 2
    assert {tables.insert_missing(old, new.repartition(n), ["set_id"]).where("set_id = 2").first().config for n in (1, 2, 3)} < {"y", "z"}
    names = spark.createDataFrame([(1, "n")] * 3, "set_id long, name string")
    assert sets.disable(names.limit(0), names).count() == 1
