import numpy as np

from palimpsest.llm import inner_topk

from .test_inner_topk import SCHEMA, brute


def test_zero_query_among_many(spark):
    """A query whose quantised vector is all zeros gets its k rows, and does not end the other queries."""
    vectors = np.random.default_rng(3).normal(size=(120, 8)).astype("float32")
    rows = [(k, v.tolist()) for k, v in enumerate(vectors, 1)] + [(0, [0.0] * 8), (140, [0.01] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    found = inner_topk.top_k(df, "vec_id % 20 = 0", query_block=4, candidate_block=32)
    assert sorted(map(tuple, found.collect())) == brute(rows, 20, lambda i: i % 20 == 0)
