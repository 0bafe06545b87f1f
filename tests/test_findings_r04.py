"""Findings of round 4 on the library's queries."""

from pyspark.sql import functions as F

from palimpsest.operators import search


def test_all_pairs_copy_no_row(spark, monkeypatch):
    """many queries and candidates are exchanged once, not once for each block that they meet; rows are those of few queries."""
    rows = [(k, [float(k), 1.0] if k % 7 else None, f"x{k}") for k in range(60)] + [(60, [1.0], "y"), (61, [float("nan"), 1.0], None)]
    df = spark.createDataFrame(rows, "uid long, embedding array<float>, kind string")
    queries = df.where("uid % 2 = 0").select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = lambda: search.scored(queries, df, metric="l2")
    plain = lambda frame: sorted((r.query_id, r.uid, r.kind or "", -1 if r.score is None else r.score) for r in frame.collect())
    wanted = plain(found())
    for name, value in (("BROADCAST_QUERIES", 3), ("PAIR_QUERIES", 4), ("PAIR_ROWS", 5), ("QUERY_PARTS", 3), ("ROW_PARTS", 4)):
        monkeypatch.setattr(search, name, value)
    many = found()
    assert plain(many) == wanted and len(wanted) == 31 * 62
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapCoGroups" not in plan


def test_all_pairs_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    df = spark.createDataFrame([(1, [1.0])], "uid long, embedding array<float>")
    queries = df.select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert search.scored(queries, df.limit(0)).count() == 0 and search.scored(queries.limit(0), df).count() == 0
    assert search.scored(queries, df).count() == 1
