"""The feature store's operators against a plain double of its contract, over random sequences of calls.

The double keeps dicts and lists and says what each call means one row at a
time; the operators make new tables. After every call both hold the same rows,
and every reading call gives the same.
"""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import features as P
from palimpsest.plans.filters import compile_filter, feature_resolver, parse_filter

START = datetime.datetime(2024, 1, 1)
FEATURES = "id long, set_id string, category string, tag string, feature string, value string, created_at timestamp"
CITATIONS = "feature_id long, history_id string"
HISTORY = "set_id string, history_id string, created_at timestamp, ingested boolean"
FIELDS = [f.split()[0] for f in FEATURES.split(", ")]


class Double:
    def __init__(self):
        self.features, self.cited, self.history = {}, {}, {}

    def insert(self, row):
        self.features.setdefault(row["id"], dict(row))

    def update(self, key, changes):
        if key in self.features:
            self.features[key].update({k: v for k, v in changes.items() if v is not None})

    def delete(self, keys):
        for key in keys:
            self.features.pop(key, None)
            self.cited.pop(key, None)

    def cite(self, key, messages):
        if key in self.features:
            self.cited.setdefault(key, set()).update(messages)

    def add_message(self, set_id, message, at):
        self.history.setdefault((set_id, message), [at, False])

    def ingest(self, set_id, messages):
        for m in messages:
            if (set_id, m) in self.history:
                self.history[set_id, m][1] = True

    def delete_messages(self, messages):
        self.history = {k: v for k, v in self.history.items() if k[1] not in messages}
        for key in self.cited:
            self.cited[key] -= set(messages)

    def delete_sets(self, sets):
        self.history = {k: v for k, v in self.history.items() if k[0] not in sets}

    def pending(self, set_id):
        return [at for (s, _), (at, done) in self.history.items() if s == set_id and not done]

    def purge(self, sets):
        idle = {s for s in sets if not self.pending(s)}
        self.history = {k: v for k, v in self.history.items() if k[0] not in idle}

    def sets(self):
        return {s for s, _ in self.history}

    def due(self, least, older_than):
        if (least is None or least <= 0) and older_than is None:
            return self.sets()
        enough = {s for s in self.sets() if least is not None and 0 < least <= len(self.pending(s))}
        return enough | {s for s in self.sets() if older_than is not None and any(at <= older_than for at in self.pending(s))}

    def with_prefix(self, prefix):
        return {s for s in self.sets() | {f["set_id"] for f in self.features.values()} if s.startswith(prefix)}

    def page(self, size, number, keep=lambda f: True):
        ordered = sorted(filter(keep, self.features.values()), key=lambda f: (f["created_at"], f["id"]))
        return [f["id"] for f in ordered[size * number : size * (number + 1)]]

    def messages(self, sets, done):
        return sum((sets is None or s in sets) and (done is None or d == done) for (s, _), (_, d) in self.history.items())

    def rows(self):
        return (
            sorted(tuple(f[c] for c in FIELDS) for f in self.features.values()),
            sorted((k, m) for k, ms in self.cited.items() for m in ms),
            sorted((s, m, at, done) for (s, m), (at, done) in self.history.items()),
        )


class Store:
    """The three tables, made new by each call."""

    def __init__(self, spark):
        self.spark = spark
        self.tables = [spark.createDataFrame([], s) for s in (FEATURES, CITATIONS, HISTORY)]

    def few(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def set(self, features=None, citations=None, history=None):
        """Rows are fixed after each call, so that plans stay short."""
        for k, (found, schema) in enumerate(zip((features, citations, history), (FEATURES, CITATIONS, HISTORY))):
            if found is not None:
                self.tables[k] = self.few(found.collect(), schema)

    def rows(self):
        columns = (FIELDS, ["feature_id", "history_id"], ["set_id", "history_id", "created_at", "ingested"])
        return tuple(sorted(tuple(r) for r in t.select(*c).collect()) for t, c in zip(self.tables, columns))


def step(double, store, draw, at):
    """One random call on both."""
    features, citations, history = store.tables
    ids, sets, messages = range(12), ["mem_a", "mem_b", "org_c"], [f"m{k}" for k in range(9)]
    some = lambda of: draw.sample(list(of), draw.randint(1, 3))
    one_of = lambda of: draw.choice(list(of))
    call = draw.choice("insert insert insert update delete where cite cite add add add ingest ingest forget forget_sets purge".split())
    if call == "insert":
        new = [dict(zip(FIELDS, (i, one_of(sets), one_of("xy"), one_of("tu"), one_of("fg"), str(draw.randint(0, 9)), at))) for i in some(ids)]
        for row in new:
            double.insert(row)
        store.set(features=P.insert_features(features, store.few([tuple(r[c] for c in FIELDS) for r in new], FEATURES)))
    elif call == "update":
        key, changes = one_of(ids), {"set_id": one_of([None, *sets]), "tag": one_of([None, "t", "u"]), "value": one_of([None, "new"])}
        double.update(key, changes)
        store.set(features=P.update_features(features, store.few([(key, *changes.values())], "id long, set_id string, tag string, value string")))
    elif call == "delete":
        keys = some(ids)
        double.delete(keys)
        left, cited = P.delete_features(features, citations, store.few([(k,) for k in keys], "id long"))
        store.set(left, cited)
    elif call == "where":
        tag, feature = one_of("tu"), one_of("fg")
        gone = [k for k, f in double.features.items() if f["tag"] == tag and not f["feature"] == feature]
        double.delete(gone)
        matched = features.where(compile_filter(parse_filter(f"tag = {tag} AND NOT feature = {feature}"), feature_resolver(features.columns))).select("id")
        left, cited = P.delete_features(features, citations, matched)
        store.set(left, cited)
    elif call == "cite":
        key, those = one_of(ids), some(messages)
        double.cite(key, those)
        store.set(citations=P.add_citations(citations, store.few([(key, m) for m in those], CITATIONS), features))
    elif call == "add":
        rows = [(one_of(sets), m, at) for m in some(messages)]
        for row in rows:
            double.add_message(*row)
        store.set(history=P.add_history(history, store.few(rows, "set_id string, history_id string, created_at timestamp")))
    elif call == "ingest":
        set_id, those = one_of(sets), some(messages)
        double.ingest(set_id, those)
        store.set(history=P.mark_ingested(history, store.few([(set_id, m) for m in those], "set_id string, history_id string")))
    elif call == "forget":
        those = some(messages)
        double.delete_messages(those)
        left, cited = P.delete_history(history, citations, store.few([(m,) for m in those], "id string"))
        store.set(citations=cited, history=left)
    elif call == "forget_sets":
        gone = one_of(sets)
        double.delete_sets([gone])
        store.set(history=P.delete_history_sets(history, store.few([(gone,)], "id string")))
    else:
        those = some(sets)
        double.purge(those)
        store.set(history=history.join(P.purgeable(history, store.few([(s,) for s in those], "id string")), ["set_id", "history_id"], "left_anti"))
    return call


def readings(double, store, draw, at):
    """Every reading call, with random arguments, gives the same from both."""
    features, _, history = store.tables
    names = lambda df: {r.set_id for r in df.collect()}
    for least in (None, -1, 0, 1, 2):
        for older in (None, at - datetime.timedelta(hours=draw.randint(1, 8))):
            assert names(P.dirty_sets(history, least, None if older is None else F.lit(older))) == double.due(least, older), (least, older)
    assert names(P.sets_with_prefix(history, features, "mem_")) == double.with_prefix("mem_")
    size, number = draw.randint(1, 4), draw.randint(0, 2)
    assert [r.id for r in P.feature_page(features, size, number).collect()] == double.page(size, number)
    tagged = features.where(compile_filter(parse_filter("tag = t"), feature_resolver(features.columns)))
    assert [r.id for r in P.feature_page(tagged, size).collect()] == double.page(size, 0, lambda f: f["tag"] == "t")
    for sets, done in ((None, None), (["mem_a", "org_c"], False), (["mem_b", "mem_b", "none"], True)):
        given = None if sets is None else store.few([(s,) for s in sets], "id string")
        assert P.history_count(history, given, done).first().n == double.messages(sets, done)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_the_double(spark, seed):
    draw, double, store = random.Random(seed), Double(), Store(spark)
    for k in range(16):
        at = START + datetime.timedelta(hours=k)
        call = step(double, store, draw, at)
        assert store.rows() == double.rows(), (k, call)
        if k % 8 == 7:
            readings(double, store, draw, at)
