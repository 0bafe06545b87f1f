"""Block scoring and the vector index against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.sources import vector_index as vi

METRICS = ("cosine", "dot", "l2", "l1")


def given(n=600, d=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d)) * 3
    x = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, d))
    x[50:60] = x[50]  # equal vectors
    x[70] = 0
    return x.astype(np.float32)


def score(q, c, metric):
    q, c = q.astype(float), c.astype(float)
    if metric == "l1":
        return np.abs(q - c).sum()
    if metric == "l2":
        return np.sqrt(((q - c) ** 2).sum())
    if metric == "dot":
        return q @ c
    lengths = np.linalg.norm(q) * np.linalg.norm(c)
    return q @ c / lengths if lengths else 0.0


def plain(queries, rows, k, metric, fits=lambda s: True):
    sign = -1 if metric in ("cosine", "dot") else 1
    out = set()
    for i, q in queries.items():
        hits = sorted((round(sign * score(q, c, metric), 9), u) for u, c in rows.items() if fits(score(q, c, metric)))
        out |= {(i, n + 1, u) for n, (_, u) in enumerate(hits[:k])}
    return out


def frames(spark, x):
    df = spark.createDataFrame([(k, v.tolist(), k % 4) for k, v in enumerate(x)], "uid long, embedding array<float>, label int").repartition(5)
    return df, df.where("uid % 20 = 10").select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))


def rows_of(df):
    return {(r.query_id, r["rank"], r.uid) for r in df.collect()}


@pytest.mark.parametrize("metric", METRICS)
def test_blocks(spark, metric, monkeypatch):
    x = given()
    df, queries = frames(spark, x)
    asked, every = {k: x[k] for k in range(10, len(x), 20)}, dict(enumerate(x))
    assert rows_of(search.knn(queries, df, 7, metric)) == plain(asked, every, 7, metric)
    limit = 4.0 if metric in ("l2", "l1") else 0.3
    fits = (lambda s: s <= limit) if metric in ("l2", "l1") else (lambda s: s >= limit)
    assert rows_of(search.knn(queries, df, 7, metric, limit)) == plain(asked, every, 7, metric, fits)
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 11)
    monkeypatch.setattr(search.B, "CELLS", 64)
    assert rows_of(search.knn(queries, df, 7, metric)) == plain(asked, every, 7, metric)
    by_label = {(r.query_id, r.label, r["rank"], r.uid) for r in search.knn(queries, df, 2, metric, per=["label"]).collect()}
    assert by_label == {(i, g, n, u) for g in range(4) for i, n, u in plain(asked, {u: v for u, v in every.items() if u % 4 == g}, 2, metric)}


def test_unsound_vectors(spark):
    """Null, empty, short and not finite vectors give no hit, as candidates and as queries."""
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.5, 0.5]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "uid long, embedding array<double>")
    queries = df.select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert rows_of(search.knn(queries, df, 9)) == {(0, 1, 0), (0, 2, 6), (6, 1, 6), (6, 2, 0), (3, 1, 3)}
    assert search.knn(queries.limit(0), df, 3).count() == 0 and search.knn(queries, df.limit(0), 3).count() == 0 and search.knn(queries, df, 0).count() == 0


@pytest.mark.parametrize("metric", ("cosine", "l2"))
def test_index(spark, tmp_path, metric):
    """The contract: add, search, remove, get, save and load, with deletions."""
    x = given(900)
    df, queries = frames(spark, x)
    asked = {k: x[k] for k in range(10, len(x), 20)}
    index = vi.VectorIndex.create(df.where("uid < 600"), f"file://{tmp_path}/a", metric, lists=16)
    index.add(df.where("uid >= 600"))
    every, exact = dict(enumerate(x)), len(index.centroids)
    assert exact == 16 and 1 <= index.probes <= 16
    assert rows_of(index.search(queries, 5, probes=exact)) == plain(asked, every, 5, metric)
    wanted, found = {(i, u) for i, _, u in plain(asked, every, 10, metric)}, {(i, u) for i, _, u in rows_of(index.search(queries, 10))}
    assert len(found & wanted) / len(wanted) >= 0.9
    index.remove(spark.createDataFrame([(k,) for k in range(0, 900, 3)] + [(5000,)], "uid long"))
    left = {u: v for u, v in every.items() if u % 3}
    assert rows_of(index.search(queries, 5, probes=exact)) == plain(asked, left, 5, metric)
    again = df.where("uid = 30").select("uid", F.transform("embedding", lambda v: v + 0.25).alias("embedding"), "label")
    index.add(again)
    left[30] = x[30] + np.float32(0.25)
    saved = index.save(f"file://{tmp_path}/b")
    for opened in (saved, vi.VectorIndex(spark, f"file://{tmp_path}/b")):
        assert rows_of(opened.search(queries, 5, probes=exact)) == plain(asked, left, 5, metric)
    saved.compact()
    assert rows_of(saved.search(queries, 5, probes=exact)) == plain(asked, left, 5, metric)
    assert {r.uid for r in saved.get(spark.createDataFrame([(30,), (31,), (33,), (7777,)], "k long")).collect()} == {30, 31}
    allowed = spark.range(0, 900, 7).toDF("uid")
    assert rows_of(saved.search(queries, 5, probes=exact, allowed=allowed)) == plain(asked, {u: v for u, v in left.items() if u % 7 == 0}, 5, metric)
    with pytest.raises(ValueError):
        saved.search(queries, 0)


def test_parts_and_blocks_of_queries(spark, tmp_path, monkeypatch):
    """A list of a third of all rows lies in several parts, many queries meet it in several tasks."""
    x = given(900)
    x[:300] = x[0]
    df, queries = frames(spark, x)
    monkeypatch.setattr(vi, "PART", 40)
    monkeypatch.setattr(vi, "QUERIES", 8)
    index = vi.VectorIndex.create(df, f"file://{tmp_path}/a", lists=8)
    assert index.store.read("cells").groupBy("list", "part").count().agg(F.max("count")).first()[0] < 120
    asked = {k: x[k] for k in range(10, len(x), 20)}
    assert rows_of(index.search(queries, 5, probes=8)) == plain(asked, dict(enumerate(x)), 5, "cosine")


def test_fallback(spark, tmp_path):
    x = given()
    df, queries = frames(spark, x)
    index = vi.VectorIndex.create(df, f"file://{tmp_path}/a")
    found = vi.filtered_search(index, queries, F.col("uid") < 40, 10, probes=99)
    by_query = {}
    for r in found.collect():
        by_query.setdefault((r.query_id, r.exact), []).append(r.uid)
    kinds = {exact for _, exact in by_query}
    assert True in kinds
    asked = {k: x[k] for k in range(10, len(x), 20)}
    for (query, exact), uids in by_query.items():
        near = plain({query: asked[query]}, dict(enumerate(x)), 40, "cosine")
        fit = [u for _, n, u in sorted(near) if u < 40]
        assert exact == (len(fit) < 5)
        assert set(uids) == ({u for _, _, u in plain({query: asked[query]}, {u: x[u] for u in range(40)}, 10, "cosine")} if exact else set(fit[:10]))
    assert vi.filtered_search(index, queries, None, 3).where("exact").count() == 0


def test_an_index_needs_vectors(spark, tmp_path):
    with pytest.raises(ValueError):
        vi.VectorIndex.create(spark.createDataFrame([(1, None)], "uid long, embedding array<float>"), f"file://{tmp_path}/a")
