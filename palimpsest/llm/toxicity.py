"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0..K are ordered; P(grade <= k) = logistic(threshold_k - w.x) with one
weight vector w for all ordered thresholds. A document's expected severity is
the sum over k >= 1 of P(grade >= k). Features are presences of words and of
word beginnings; those that tell the grades apart best are kept.

The model is fitted from a bounded sample of labelled rows (SAMPLE rows, the first
by a hash of the id): features are counted and chosen on the executors, the driver
fits their weights. It is applied to every whole text.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Cache, map_arrow, slices, stored, whole_text

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 6000
#: Features of a model, at most; features of fewer fitted documents, or a lower chi-square, are not looked at.
FEATURES, LEAST_DOCUMENTS, LEAST_CHI = 3000, 5, 25.0
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
#: Words of least hash by which fitted near copies are known.
SKETCH = 3
#: Grades above 0 that binary labels are spread over.
GRADES = 3
#: Documents of at least this expected severity are rejected.
REJECT_AT = 0.5
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Ordinal:
    """Weights by feature and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: Iterable[float]):
        self.weights, self.thresholds = weights, np.array(list(thresholds), dtype=np.float64)
        self.cache = Cache(lambda words: [tuple(f for f in word_features(word) if f in weights) for word in words])

    def score(self, text: str) -> float:
        found: set[str] = set()
        found.update(*self.cache.many(list(words(text))))
        return sum(sorted(self.weights[f] for f in found))

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a column each."""
        return logistic(scores[:, None] - self.thresholds[None, :])

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "thresholds": self.thresholds.tolist()})

    @staticmethod
    def from_json(text: str) -> Ordinal:
        return Ordinal(**json.loads(text))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, top: int, penalty: float = 0.05, steps: int = 700, rate: float = 0.08) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the `top` ordered thresholds by penalised maximum likelihood (full-batch Adam, fixed start)."""
    n, d = x.shape
    shares = np.clip([(grades >= k).mean() for k in range(1, top + 1)], 1e-4, 1 - 1e-4)
    start = -np.log(shares / (1 - shares))
    # theta_1, then logarithms of the positive steps between thresholds
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    w = np.zeros(d)
    m, v = np.zeros(d + top), np.zeros(d + top)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        thresholds = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        s = x @ w
        # upper and lower cumulative probabilities of the observed grade
        cumulative = np.concatenate([np.zeros((n, 1)), logistic(thresholds[None, :] - s[:, None]), np.ones((n, 1))], axis=1)
        upper, lower = cumulative[rows, grades + 1], cumulative[rows, grades]
        p = np.maximum(upper - lower, 1e-12)
        slope = lambda c: c * (1 - c)
        g_s = (slope(upper) - slope(lower)) / p
        g_t = np.zeros(top)
        for k in range(top):
            g_t[k] = (-(slope(upper) / p)[grades == k].sum() + (slope(lower) / p)[grades == k + 1].sum()) / n
        suffix = np.cumsum(g_t[::-1])[::-1]
        gradient = np.concatenate([x.T @ g_s / n + penalty / n * w, suffix[:1], suffix[1:] * np.exp(theta[1:])])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, theta = w - move[:d], theta - move[d:]
    return w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def graded(matrix: np.ndarray, toxic: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Grades of binary labels: toxic documents are cut at the quantiles of their number of strongly toxic features."""
    hits = matrix[:, strong].sum(axis=1)
    grades = np.zeros(len(toxic), dtype=np.int64)
    at = np.flatnonzero(toxic > 0)
    if len(at):
        edges = np.quantile(hits[at], np.arange(1, GRADES) / GRADES)
        grades[at] = 1 + np.searchsorted(edges, hits[at], side="left")
        grades[at] = np.unique(grades[at], return_inverse=True)[1] + 1  # no empty grade between
    return grades


def sketch_of(found: set[str]) -> tuple[int, ...]:
    """The least hashes of a text's words: near copies share them."""
    return tuple(heapq.nsmallest(SKETCH, (zlib.crc32(w.encode()) for w in found)))


def features_of(found: set[str]) -> set[str]:
    return {f for w in found for f in word_features(w)}


def chi_square(seen, hits, n: int, positive: int):
    """Of a feature's presence (in `seen` of n texts, `hits` of the `positive` ones) against a positive label."""
    a, b = hits, seen - hits
    c, d = positive - hits, n - positive - b
    return n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)


def fit(texts: list[str], labels: list[int]) -> Ordinal:
    """A model from texts and integer labels; labels of 0 and 1 only are spread over GRADES (see graded).

    Of near copies, which share their words of least hash, one is fitted: else their
    rare words look telling. Without a row of a positive grade nothing is ever rejected.
    """
    seen_sketches: set[tuple] = set()
    cells, kept_labels = [], []
    for text, label in zip(texts, labels):
        found = words(text)
        if (sketch := sketch_of(found)) not in seen_sketches:
            seen_sketches.add(sketch)
            cells.append(features_of(found))
            kept_labels.append(label)
    n, positive = len(cells), sum(x > 0 for x in kept_labels)
    if not positive or positive == n:
        return fit_features([], [], [], kept_labels)
    seen, hits = Counter(f for c in cells for f in c), Counter(f for c, x in zip(cells, kept_labels) if x > 0 for f in c)
    able = [(-float(chi_square(np.float64(seen[f]), np.float64(hits[f]), n, positive)), f) for f in seen if seen[f] >= LEAST_DOCUMENTS]
    names = [f for chi, f in sorted(able)[:FEATURES] if -chi >= LEAST_CHI]
    place = {f: k for k, f in enumerate(names)}
    return fit_features(names, [(seen[f], hits[f]) for f in names], [[place[f] for f in c if f in place] for c in cells], kept_labels)


def fit_features(names: list[str], counts: list[tuple[int, int]], cells: list[list[int]], kept_labels: list[int]) -> Ordinal:
    """A model from the chosen features, their counts (texts, positive texts), and the features and label of each text."""
    labels = np.array(kept_labels, dtype=np.int64)
    n, positive = len(labels), int((labels > 0).sum())
    if not positive or positive == n:
        return Ordinal({}, [50.0] if not positive else [-50.0])
    matrix = np.zeros((n, len(names)))
    for row, cell in enumerate(cells):
        matrix[row, cell] = 1
    strong = np.array([k for k, (seen, hits) in enumerate(counts) if hits >= 20 * (seen - hits + 0.05) * positive / (n - positive)], dtype=np.int64)
    grades = labels if labels.max() > 1 else graded(matrix, labels, strong)
    w, thresholds = fit_ordinal(matrix, grades, int(grades.max()))
    return Ordinal({f: float(x) for f, x in zip(names, w)}, thresholds)


class FeaturesTask:
    """doc_id, label, sketch and features of each text."""

    def __call__(self, batch: pa.RecordBatch) -> dict:
        found = [words(t.as_py()) for t in batch.column(2)]
        return {"doc_id": batch.column(0), "label": batch.column(1), "sketch": [",".join(map(str, sketch_of(w))) for w in found], "features": [sorted(features_of(w)) for w in found]}


def train(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """Fits on the first `sample` labelled rows by a hash of doc_id; null labels and labelled ids without a text are left out.

    Of labelled texts that share their three words of least hash (near copies) only
    the first by id is fitted, whatever the labels of the others. No labelled row
    gives a model that rejects nothing; columns other than the ids, text and label
    are not looked at. Texts stay on the executors: the driver gets the chosen
    features (FEATURES at most) and which of them each fitted text has.
    """
    picked = labels.where(F.col(label_column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(label_column).cast("long").alias("label"))
    picked = picked.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "label").limit(sample).drop("order")
    # at most `sample` rows: their size is bounded, so the documents stay where they are
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = given.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
    found = stored(map_arrow(rows, FeaturesTask, "doc_id long, label long, sketch string, features array<string>"), "labelled")
    first = W.partitionBy("sketch").orderBy("doc_id", "label", F.xxhash64("features"))
    kept = stored(found.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.struct("doc_id", "sketch").alias("row"), "label", "features"), "fitted")
    totals = kept.agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("positive")).first()
    n, positive = totals.n, totals.positive or 0
    if not positive or positive == n:
        return fit_features([], [], [], [1] * positive + [0] * (n - positive))
    seen = kept.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").cast("double").alias("seen"), F.sum((F.col("label") > 0).cast("double")).alias("hits"))
    a, b = F.col("hits"), F.col("seen") - F.col("hits")
    c, d = F.lit(float(positive)) - F.col("hits"), F.lit(float(n - positive)) - b
    scored = seen.where(F.col("seen") >= LEAST_DOCUMENTS).withColumn("chi", F.lit(float(n)) * (a * d - b * c) * (a * d - b * c) / F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(1.0)))
    chosen = scored.where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()
    places = {r.feature: k for k, r in enumerate(chosen)}

    class PlacesTask:
        def __call__(self, batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "label": batch.column(1), "cell": [[places[f] for f in x if f in places] for x in batch.column(2).to_pylist()]}

    cells = map_arrow(kept.select("row.doc_id", "label", "features"), PlacesTask, "doc_id long, label long, cell array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return fit_features(list(places), [(int(r.seen), int(r.hits)) for r in chosen], cells["cell"].to_pylist(), cells["label"].to_pylist())


class ScoreTask:
    def __init__(self, model: str):
        self.model = Ordinal.from_json(model)

    def __call__(self, batch: pa.RecordBatch) -> dict:
        scores = np.array([self.model.score(t.as_py()) for t in batch.column(1)], dtype=np.float64)
        at_least = self.model.at_least(scores)
        return {"doc_id": batch.column(0), "severity": np.round(at_least.sum(axis=1), 9), "grade": (at_least >= 0.5).sum(axis=1)}


def score(docs: DataFrame, model: Ordinal, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, severity (expected), grade (median), rejected of every whole text.

    Null and empty texts have no features and get the model's base severity.
    Repeated rows stay; other columns are ignored; an empty table gives no row.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    text = model.to_json()
    return map_arrow(given, lambda: ScoreTask(text), "doc_id long, severity double, grade int").withColumn("rejected", F.col("severity") >= reject_at)


def keep_clean(docs: DataFrame, model: Ordinal, reject_at: float = REJECT_AT) -> DataFrame:
    """The documents that are not rejected, whole and with all columns, in one pass.

    Null and empty texts have no features and stay unless the base severity alone
    rejects; null ids and repeated rows stay; an empty table stays empty; columns
    of any name are kept.
    """
    text = model.to_json()
    columns = docs.columns


    def run(batches):
        ordinal = Ordinal.from_json(text)
        for batch in (part for whole in batches for part in slices(whole)):
            scores = np.array([ordinal.score(t.as_py() or "") for t in batch.column(columns.index("text"))], dtype=np.float64)
            severity = np.round(ordinal.at_least(scores).sum(axis=1), 9)
            yield pa.RecordBatch.from_arrays(batch.columns, names=columns).filter(pa.array(severity < reject_at))

    # by place, as a column's name may hold a point
    return docs.toDF(*[f"c{k}" for k in range(len(columns))]).mapInArrow(run, docs.schema)
