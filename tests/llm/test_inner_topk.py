import math

import numpy as np
import pytest

from palimpsest.llm import inner_topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, chosen):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if not chosen(i):
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("n", "block"), [(90, 16), (300, 64)])
def test_top_k(spark, n, block):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, 8)) * rng.exponential(size=(n, 1))).astype("float32")
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000 + k, vectors[3].tolist()) for k in range(40)]  # ties
    rows += [(2000, None), (2020, [None] * 8), (2040, [math.nan] * 8), (2060, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (2080, [0.5, 1.0]), (2100, [0.25, 1.0]), (2120, []), (2121, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    found = inner_topk.top_k(df, "vec_id % 20 = 0", query_block=block // 4, candidate_block=block)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    wanted = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20, lambda i: i % 20 == 0)
    assert sorted(map(tuple, found.collect())) == wanted


def test_empty_and_few(spark):
    assert inner_topk.top_k(spark.createDataFrame([], SCHEMA), "vec_id % 20 = 0").count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1)], SCHEMA)
    assert [tuple(r) for r in inner_topk.top_k(few, "vec_id % 20 = 0").collect()] == [(0, 1, 1, 64 * 32)]
    assert [tuple(r) for r in inner_topk.top_k(few.union(few), "vec_id % 20 = 0", k=1).dropDuplicates().collect()] == [(0, 1, 1, 64 * 32)]


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e7, 1.0], 0), (1, [2.9e7, 5.0], 0), (2, [2.9e7, 6.0], 0)]
    found = inner_topk.top_k(spark.createDataFrame(rows, SCHEMA), "vec_id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(r[3 - 1], r[3]) for r in brute([(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows], 20, lambda i: i == 0)]


@pytest.mark.parametrize("same", [False, True])
def test_blocks_follow_rows(spark, same):
    """The number of blocks does not depend on the partitions, also where all norms are equal; no row is lost."""
    rng = np.random.default_rng(3)
    rows = [(k, [1, 2, 3] if same else rng.integers(-50, 50, 3).tolist()) for k in range(500)]
    given = spark.createDataFrame(rows, "vec_id long, v array<long>")
    for n in (1, 40):
        found = inner_topk.blocked(given.repartition(n), 50, True, "test").collect()
        assert 10 <= len(found) <= 21
        ids = np.concatenate([np.frombuffer(r.ids, dtype=np.int64) for r in found])
        assert sorted(ids.tolist()) == list(range(500))
        assert len({r.block for r in found}) == len(found)


def test_slots(spark, monkeypatch):
    """Blocks of longest vectors that are not broadcast are dealt out by slots; the result is the same."""
    monkeypatch.setattr(inner_topk, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(inner_topk, "SLOT", 2)
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=4 if k % 3 else 6).astype("float32").tolist()) for k in range(400)]
    found = inner_topk.top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), "vec_id % 20 = 0", query_block=4, candidate_block=32)
    assert sorted(map(tuple, found.collect())) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 20, lambda i: i % 20 == 0)


def test_by_slots(spark):
    queries = spark.createDataFrame([(1, k) for k in range(20)] + [(2, 50)], "d int, q_block long")
    candidates = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 10)], "d int, c_block long")
    for slots in (1, 5):
        found = inner_topk.by_slots(queries, candidates, slots).collect()
        assert sorted((r.q_block, r.c_block) for r in found) == sorted([(k, c) for k in range(20) for c in (7, 8)] + [(50, 9)])
