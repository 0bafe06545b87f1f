"""The filter language: reading, rewriting, and truth tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.properties import contains, decode, encode, scalars_only, typed_map, typed_value
from palimpsest.plans import filters as L
from palimpsest.plans.filters import And, Comparison, In, IsNull, Not, Or, compile_filter, parse_filter, resolver


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("owner = 'alice'", Comparison("owner", "=", "alice")),
        ("owner = alice", Comparison("owner", "=", "alice")),
        ("status <> 'CLOSED'", Comparison("status", "!=", "CLOSED")),
        ("priority in (HIGH,LOW)", In("priority", ("HIGH", "LOW"))),
        ("code NOT IN (1, 2, 3)", Not(In("code", (1, 2, 3)))),
        ("count = 10 AND pi = 3.14", And(Comparison("count", "=", 10), Comparison("pi", "=", 3.14))),
        ("done = true and flag = FALSE", And(Comparison("done", "=", True), Comparison("flag", "=", False))),
        ("a = 1 OR b = 2 AND c = 3", Or(Comparison("a", "=", 1), And(Comparison("b", "=", 2), Comparison("c", "=", 3)))),
        ("(a = 1 OR b = 2) AND c = 3", And(Or(Comparison("a", "=", 1), Comparison("b", "=", 2)), Comparison("c", "=", 3))),
        ("NOT NOT status = 'OPEN'", Not(Not(Comparison("status", "=", "OPEN")))),
        ("NOT a = 1 AND b = 2", And(Not(Comparison("a", "=", 1)), Comparison("b", "=", 2))),
        ("metadata.note IS NULL", IsNull("metadata.note")),
        ("m.note is not null", Not(IsNull("m.note"))),
        ("x = -5", Comparison("x", "=", 5)),
        ("at < date('2026-01-19T01:56:41.513342Z')", Comparison("at", "<", dt.datetime(2026, 1, 19, 1, 56, 41, 513342, dt.UTC))),
        ("date = 3", Comparison("date", "=", 3)),
        ("v = 1.2.3", Comparison("v", "=", "1.2.3")),
        ("", None),
        (None, None),
    ],
)
def test_parse(text, tree):
    assert parse_filter(text) == tree


@pytest.mark.parametrize("text", ["owner =", "x IN (1, 'two')", "flag IN (true, false)", "x IN (1.5, 2.5)", "x IN ()", "status NOT 'CLOSED'", "a<date('invalid-date')", "name = 'O''Brien'", "a = 1 b = 2", "(a = 1", "a IS 3"])
def test_errors(text):
    with pytest.raises(L.FilterError):
        parse_filter(text)


def test_strict():
    with pytest.raises(L.FilterError):
        parse_filter("x = -5", strict=True)


def test_rewrites():
    tree = parse_filter("set_id IN (a, b) AND m.k = 1 AND NOT note IS NULL")
    assert L.fields(L.map_fields(tree, str.upper)) == ["SET_ID", "M.K", "NOTE"]
    assert L.definite_values(tree, "set_id") == {"a", "b"}
    assert L.definite_values(L.merge(tree, parse_filter("set_id = b")), "set_id") == {"b"}
    assert L.definite_values(parse_filter("set_id = a OR x = 1"), "set_id") is None
    assert L.equalities(parse_filter("a = 1 AND b = x")) == {"a": 1, "b": "x"}
    with pytest.raises(TypeError):
        L.equalities(parse_filter("a > 1"))
    assert L.from_dict({"a": "x", "b": "O'B"}) == "a='x' AND b='O''B'"
    assert L.within_sets(None, ["s"]) == In("set_id", ("s",))
    assert L.merge(None, None) is None
    with pytest.raises(L.FilterError):
        L.check_fields(parse_filter("m.other = 1"), {"k"})
    assert not L.valid_identifier("a" * 33) and not L.valid_identifier("A")


ROWS = [("alpha", 5, 1.5, True, "a"), ("beta", 10, 2.5, False, "b"), ("gamma", 15, 3.5, True, "c"), ("delta", 20, 4.5, False, "d")]
TIMES = {"alpha": "2024-01-10T12:00:00+00:00", "beta": "2024-03-15T08:00:00-05:00", "gamma": "2024-06-20T21:00:00+09:00", "delta": "2024-09-01T00:00:00+00:00"}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(n, f'{{"count": {c}, "score": {s}, "active": {str(a).lower()}, "tag": "{t}"}}') for n, c, s, a, t in ROWS], "name string, meta string")


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(n, c, s, a, t, TIMES[n]) for n, c, s, a, t in ROWS] + [("epsilon", 0, None, True, None, None)]
    df = spark.createDataFrame(rows, "name string, c long, s double, a boolean, t string, ts string")
    entries = {"count": typed_value("int", F.col("c")), "score": typed_value("float", F.col("s")), "active": typed_value("bool", F.col("a")), "tag": typed_value("str", F.col("t")), "ts": typed_value("datetime", F.col("ts").cast("timestamp"))}
    return df.select("name", typed_map(entries).alias("p"))


def names(df, text, target, two_valued=False):
    return {r.name for r in df.where(compile_filter(parse_filter(text), target, two_valued)).collect()}


def test_raw_json(raw):
    target = resolver({"name": "name"}, "meta")
    assert names(raw, "m.count > 10 AND m.active = true", target) == {"gamma"}
    assert names(raw, "m.score <= 2.5", target) == {"alpha", "beta"}
    assert names(raw, "m.tag IN (a, d) OR name = beta", target) == {"alpha", "beta", "delta"}
    assert names(raw, "NOT m.count IN (5, 10)", target) == {"gamma", "delta"}
    assert names(raw, "m.none IS NULL AND m.tag IS NOT NULL", target) == {"alpha", "beta", "gamma", "delta"}
    assert names(raw, "m.none = 1", target) == names(raw, "NOT m.none = 1", target) == set()
    with pytest.raises(TypeError):
        names(raw, "m.count > date('2024-01-01')", target)
    with pytest.raises(L.FilterError):
        names(raw, "other = 1", target)


def test_typed(typed):
    target = resolver({}, "p", typed=True)
    everyone = {"alpha", "beta", "gamma", "delta", "epsilon"}
    assert names(typed, "m.tag IS NULL", target) == {"epsilon"}
    assert names(typed, "m.count > 10 AND m.active = true", target) == {"gamma"}
    assert names(typed, "m.tag = a OR m.tag = c", target) == {"alpha", "gamma"}
    assert names(typed, "NOT m.count > 10", target) == {"alpha", "beta", "epsilon"}
    assert names(typed, "NOT m.tag IN (a,b)", target) == {"gamma", "delta"}
    assert names(typed, "NOT (m.count > 10 AND m.active = true)", target) == everyone - {"gamma"}
    assert names(typed, "m.count = 10.0", target) == set() and names(typed, "NOT m.count = 10.0", target) == everyone
    assert names(typed, "m.ts > date('2024-03-15T13:00:00')", target) == {"gamma", "delta"}
    assert names(typed, "m.ts = date('2024-06-20T12:00:00Z')", target) == {"gamma"}
    assert {r.name for r in typed.where(compile_filter(In("m.tag", ()), target)).collect()} == set()


def test_two_valued(typed):
    target = resolver({}, "p", typed=True)
    assert names(typed, "m.tag != a", target, True) == {"beta", "gamma", "delta", "epsilon"}
    assert names(typed, "NOT m.tag = a", target, True) == {"beta", "gamma", "delta", "epsilon"}
    assert names(typed, "m.tag != a", target) == {"beta", "gamma", "delta"}


def test_properties_round_trip(typed):
    back = typed.select("name", "p", decode(encode(F.col("p"))).alias("q"))
    for r in back.collect():
        assert {k: v.asDict() for k, v in r.p.items()} == {k: v.asDict() for k, v in r.q.items()}


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2}, "d": null, "e": "x"}',)], "m string")
    assert df.select(scalars_only(F.col("m"))).first()[0] == {"a": "1", "e": "x"}
    assert df.select(contains(F.col("m"), {"e": "x"}), contains(F.col("m"), {"e": "y"})).first()[:] == (True, False)
