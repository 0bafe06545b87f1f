import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import toxicity


def made(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    texts, labels = [], []
    for k in range(n):
        bad = k % 6 == 0
        found = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(2, 8) if bad else 0):
            found.insert(rng.randrange(len(found)), rng.choice(["nasty", "vile", "awful", "zorgo" + word()]))
        texts.append(" ".join(found))
        labels.append(int(bad))
    return texts, labels


def test_held_out():
    model = toxicity.fit(*made(900, 1))
    texts, labels = made(600, 2)
    severity = model.at_least(np.array([model.score(t) for t in texts])).sum(axis=1)
    labels = np.array(labels)
    assert (severity[labels == 1] >= 0.5).mean() > 0.97 and (severity[labels == 0] >= 0.5).mean() < 0.01
    assert (np.diff(model.thresholds) > 0).all()


def test_gradient_fits_known_model():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 3)).astype(float)
    latent = x @ [2.0, -1.0, 0.5] + rng.logistic(size=4000)
    grades = (latent > 0.5).astype(int) + (latent > 2)
    w, thresholds = toxicity.fit_ordinal(x, grades, 2)
    assert np.allclose(w, [2.0, -1.0, 0.5], atol=0.25) and np.allclose(thresholds, [0.5, 2.0], atol=0.25)


def test_expected_severity_grows_with_hits():
    model = toxicity.fit(*made(900, 1))
    a, b = model.at_least(np.array([model.score("nasty thing"), model.score("nasty vile awful thing")])).sum(axis=1)
    assert a < b <= len(model.thresholds)


def test_tables(spark, documents):
    texts, labels = made(300, 3)
    given = documents([*texts, None, "", texts[0]])
    marks = spark.createDataFrame([(k, x) for k, x in enumerate(labels)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(given, marks)
    rows = toxicity.score(given.withColumn("severity", F.lit(1)), model).orderBy("doc_id").collect()
    assert len(rows) == 303 and not rows[300].rejected and not rows[301].rejected
    assert rows[302].severity == rows[0].severity
    kept = toxicity.keep_clean(given, model)
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in rows if not r.rejected]
    assert kept.columns == given.columns
    none = marks.limit(0)
    assert not any(r.rejected for r in toxicity.score(given, toxicity.train(given, none)).collect())
    assert toxicity.score(documents([]), model).count() == 0


def test_given_grades(spark, documents):
    texts, labels = made(300, 3)
    grades = [2 * x for x in labels]
    assert len(toxicity.fit(texts, [g if k % 12 else 1 if g else 0 for k, g in enumerate(grades)]).thresholds) == 2


def test_training_on_tables_equals_training_on_texts(spark, documents):
    texts, labels = made(400, 5)
    texts += [texts[6], texts[6] + " " + texts[6]]  # near copies share their words
    labels += [0, 1]
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    by_table, by_text = toxicity.train(documents(texts).repartition(3), marks), toxicity.fit(texts, labels)
    assert set(by_table.weights) == set(by_text.weights) and len(by_text.weights) > 3
    assert np.allclose([by_table.weights[f] for f in by_text.weights], list(by_text.weights.values()), atol=1e-6)
    assert np.allclose(by_table.thresholds, by_text.thresholds, atol=1e-6)


def test_query_against_plain_scores(spark, small):
    """Every row of the query from the model's numbers by plain arithmetic, over the whole small table."""
    import math
    import re

    from palimpsest.llm import queries

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op9_toxicity(spark, small).collect()
    assert len(rows) == docs.count()
    for r in rows:
        found = {x for w in re.findall(r"[^\W\d_]+", texts[r.doc_id].lower()) for x in (w, w[:4] + "*" if len(w) >= 4 else w, w[:5] + "*" if len(w) >= 5 else w, w[:6] + "*" if len(w) >= 6 else w)}
        score = sum(model.weights.get(f, 0.0) for f in found)
        chances = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(r.severity - sum(chances)) < 1e-6
        assert r.grade == sum(x >= 0.5 for x in chances) and r.rejected == (r.severity >= toxicity.REJECT_AT)


def test_weights_are_a_maximum():
    """The penalised likelihood, worked out grade by grade, does not grow in any direction from what was fitted."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (800, 4)).astype(float)
    latent = x @ [1.5, -1.0, 0.3, 0.0] + rng.logistic(size=800)
    grades = (latent > 0.2).astype(int) + (latent > 1.5)
    w, thresholds = toxicity.fit_ordinal(x, grades, 2, steps=4000, rate=0.02)

    def likelihood(w, t):
        below = lambda k, s: 0.0 if k < 0 else 1.0 if k > 1 else 1 / (1 + np.exp(s - t[k]))
        return sum(np.log(below(g, s) - below(g - 1, s)) for g, s in zip(grades, x @ w)) - 0.05 / 2 * (w @ w)

    best = likelihood(w, thresholds)
    for k in range(4):
        for step in (0.05, -0.05):
            assert likelihood(w + step * np.eye(4)[k], thresholds) < best
    for k in range(2):
        for step in (0.05, -0.05):
            assert likelihood(w, thresholds + step * np.eye(2)[k]) < best
