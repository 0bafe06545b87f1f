import random

from palimpsest.llm import components as c


def brute(edges):
    up = {}

    def root(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    return {k: root(k) for k in up}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(0, 60)]
    for edges in ([], [(1, 1), (None, 2)], [(3, 2), (2, 3)], chain, [(0, k) for k in range(1, 50)], [(99, k) for k in range(50)], [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]):
        found = c.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.component for r in found} == brute(edges) and len(found) == len(brute(edges))


def test_stars_take_no_step(spark, monkeypatch):
    """Links that are stars already, as blocks give them, are not written over and over."""
    steps, step = [], c._small_star
    monkeypatch.setattr(c, "_small_star", lambda edges: steps.append(1) or step(edges))
    assert c.components(spark.createDataFrame([(1, k) for k in range(2, 9)], "a long, b long")).count() == 8 and not steps
    assert c.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 3 and len(steps) == 1
