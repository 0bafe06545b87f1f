"""The digest index against a plain grouping."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup as ed
from palimpsest.llm.common import stored
from palimpsest.llm.queries import op13_exact_dedup
from palimpsest.llm.sql import ORACLE_SQL

from ..compare import compared

SCHEMA = "doc_id long, text string"


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]", "", t or "")].append((i, t or ""))
    out = []
    for bare, members in groups.items():
        members.sort(key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, members[0][0], len(members), k == 0, hashlib.sha256(bare.encode()).hexdigest()) for k, (i, _) in enumerate(members)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts():
    rng = random.Random(1)
    base = ["", " ", None, "a b", "ab", "a\tb\n", "a b", "é", "é", "x" * 50_000, "\x0b\x0c", "\x1c"]
    rows = [(k, rng.choice(base)) for k in range(200)] + [(200 + k, "hot text" + " " * (k % 3)) for k in range(300)]
    return rows + [(None, "ab"), (None, "only without an id"), (3, rows[3][1]), (3, rows[3][1]), (7, "two texts of one id")]


def test_rows(spark):
    rows = texts()
    given = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(ed.dedup(given)) == plain(rows)
    clashing = given.withColumns({c: F.lit("x") for c in "digest best copies batch fresh row size keep_id kept".split()})
    assert rows_of(ed.dedup(clashing, batches=3)) == plain(rows)
    assert ed.dedup(given.limit(0)).count() == 0


def test_index_outlives_its_session(spark, tmp_path):
    """A second run opens the index, finds what the first one left and says who stays now."""
    path, rows = f"file://{tmp_path}/index", texts()
    first, second = rows[:260], rows[260:]
    ed.dedup(spark.createDataFrame(first, SCHEMA), path)
    ed.DigestIndex(spark, path).forget()
    index = ed.DigestIndex(spark, path, buckets=99)
    assert index.buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ed.dedup(spark.createDataFrame(second, SCHEMA), path)
    both = defaultdict(list)
    for r in plain(rows):
        both[r[4]].append(r)
    for doc_id, keep_id, size, kept, name in found.collect():
        assert size == both[name][0][2]
        assert keep_id == both[name][0][1]
        assert kept in {r[3] for r in both[name] if r[0] == doc_id}
    assert index.entries().where("fresh").count() == len(both)
    assert index.entries().where("fresh").select("digest").distinct().count() == len(both)


def test_a_batch_that_was_stopped(spark, tmp_path):
    """What one of the two appends left is not appended again."""
    rows = texts()
    index = ed.DigestIndex(spark, f"file://{tmp_path}/index", 3)
    signed = stored(ed.signatures(spark.createDataFrame(rows, SCHEMA)), "signed").withColumn("batch", F.pmod("row", F.lit(2)))
    index.add(signed, 0)
    index.add(signed, 0)
    index.add(signed, 1)
    entries = index.entries().collect()
    again = [r for r in entries if r.batch == 1 and not r.fresh]
    assert again
    half = ed.DigestIndex(spark, f"file://{tmp_path}/half", 3)
    half.add(signed, 0)
    spark.createDataFrame([r for r in entries if r.batch == 1 and r.fresh], ed.ENTRY).write.insertInto(half.name)
    half.add(signed, 1)
    assert rows_of(half.resolve(signed)) == rows_of(index.resolve(signed)) == plain(rows)


def test_one_file_per_bucket_and_append(spark, tmp_path):
    rows = texts()
    index = ed.DigestIndex(spark, f"file://{tmp_path}/index", 3)
    signed = stored(ed.signatures(spark.createDataFrame(rows, SCHEMA)), "signed").withColumn("batch", F.lit(0).cast("long"))
    index.add(signed, 0)
    assert len(list(tmp_path.glob("index/entries/*.parquet"))) <= 3
    plan = signed.join(index.entries().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_query(spark, shop, small):
    assert compared(spark, shop, small, op13_exact_dedup, ORACLE_SQL["op13_exact_dedup"]) is None
