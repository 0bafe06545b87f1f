import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components, ngram_join


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def brute(texts, words, at_least):
    sets = [shingles(t, words) for t in texts]
    label = list(range(len(texts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= at_least * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [(k, len(sets[k]), root(k)) for k in range(len(sets))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(40)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two three", "two one", "a b c d", "a b c d e", "a\x0bb c d"]
    for size in (6, 9, 15, 30, 60, 120, 300, 900):
        for _ in range(3):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (0, 1, 1, 2, 3, size // 40, size // 20, size // 30):
                copy = list(base)
                for _ in range(changes):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([[], [word()], [copy[at].upper()], [copy[at], word()]])
                texts.append(" ".join(copy))
            texts.append(" ".join(base[:5] + passage + base[5:]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("words", "at_least", "tile"), [(3, 90, None), (5, 80, None), (3, 90, 4)])
def test_classes(spark, documents, monkeypatch, words, at_least, tile):
    if tile:
        monkeypatch.setattr(ngram_join, "TILE_SETS", tile)
    texts = corpus(words + at_least)
    found = ngram_join.classes(documents(texts).repartition(3), words, at_least).collect()
    assert sorted(map(tuple, found)) == brute(texts, words, at_least)


def test_no_link_is_lost_by_signatures():
    rng = np.random.default_rng(1)
    for words, at_least in ((3, 90), (5, 80), (3, 60)):
        rule = ngram_join.Rule(words, at_least)
        linked = 0
        for _ in range(600):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop, add = int(rng.integers(0, max(1, n // 5) + 1)), int(rng.integers(0, max(1, n // 5) + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            overlap = len(np.intersect1d(a, b))
            if len(a) and len(b) and 100 * overlap >= at_least * (len(a) + len(b) - overlap) and not np.array_equal(a, b):
                linked += 1
                assert np.intersect1d(ngram_join.signatures(a, rule), ngram_join.signatures(b, rule)).size
        assert linked > 50


def test_sets_equal_sliding_words():
    texts = ["a b c a b c a b c", "A  b\tc", "", "x", "é Ü é ü", "a b c a b c"]
    for words in (1, 3, 5):
        assert [len(s) for s in ngram_join.ngram_sets(texts, words)] == [len(shingles(t, words)) for t in texts]
    one, two = ngram_join.ngram_sets(["p q r s t", "zz p q r s"], 3)
    assert len(np.intersect1d(one, two)) == 2


def test_no_and_repeated_rows(spark, documents):
    assert ngram_join.classes(documents([])).count() == 0
    given = documents(["a b c d", "a b c d", "q"], ids=[4, 4, 2]).withColumn("node", F.lit("x")).withColumn("component", F.lit(1))
    assert sorted(map(tuple, ngram_join.classes(given).collect())) == [(2, 1, 2), (4, 2, 4), (4, 2, 4)]


def test_one_of_each(spark, documents):
    base = " ".join(f"w{k}" for k in range(100))
    kept = ngram_join.one_of_each(documents([base + " x", "other words entirely here now", base, base + " y", None, None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 5]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7), (None, 3)]
    label = {k: k for e in edges for k in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in label.items() if k is not None and sum(label[x] == v for x in label if x is not None) > 1}


def test_sets_are_exchanged(spark):
    """What a tile gets is a text's sorted set, once for each place: a text that repeats itself is as small as its set."""
    import pyarrow as pa

    texts = ["a b " * 50_000, "one two three four", ""]
    places = [[{"pair": 1, "side": 0, "node": 7}, {"pair": 2, "side": 1, "node": 7}], [{"pair": 1, "side": 1, "node": 8}], []]
    found = ngram_join.ElementsTask(ngram_join.Rule(3, 90, 100))(pa.record_batch({"places": places, "text": texts}))
    assert [len(x) for x in found["elements"]] == [16, 16, 0]
    assert found["places"].to_pylist() == places
