"""Sessions and the interval join against plain loops."""

import datetime as dt
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import interval_join as ij
from palimpsest.llm.queries import op12_interval_join
from palimpsest.llm.sql import ORACLE_SQL

from ..compare import compared

EPOCH = dt.datetime(1970, 1, 1)
SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz"
LINES = "sale_id long, shipped_at timestamp_ntz"
CLICKS = "client_id long, ts timestamp_ntz, kind string"


def at(us):
    return None if us is None else EPOCH + dt.timedelta(microseconds=us)


def plain_sessions(clicks, gap):
    found = defaultdict(list)
    for client, us, kind in sorted((c for c in clicks if c[0] is not None and c[1] is not None), key=lambda c: c[:2]):
        runs = found[client]
        if not runs or us - runs[-1][-1][0] > gap:
            runs.append([])
        runs[-1].append((us, kind))
    return {(c, r[0][0], r[-1][0], any(k == "click" for us, k in r if us == r[-1][0])) for c, runs in found.items() for r in runs}


def plain_join(sales, lines, clicks, gap=ij.GAP, slot=ij.DAY):
    inf, out = float("inf"), defaultdict(lambda: [0, 0, 0])
    sessions = [(c, a // slot, inf if open_ else b // slot, zlib.crc32(str(a).encode())) for c, a, b, open_ in plain_sessions(clicks, gap)]
    names = [["overlaps", "finished_by", "contains"], ["starts", "equals", "started_by"], ["during", "finishes", "overlapped_by"]]
    side = lambda x, y: 0 if x < y else 1 if x == y else 2
    for row, (sale, client, status, sold) in enumerate(sales):
        if client is None or sold is None:
            continue
        end = max([sold] + [us for s, us in lines if s == sale and s is not None and us is not None])
        a, b = sold // slot, inf if status == "held" else end // slot
        for c, x, y, crc in sessions:
            if c == client and a <= y and x <= b:
                sums = out[row, sale, names[side(a, x)][side(b, y)]]
                shared = min(b, y) - max(a, x) + 1
                sums[0] += 1
                sums[1] = None if shared == inf else sums[1] + shared
                sums[2] += crc
    return sorted(((sale, name, *sums) for (_, sale, name), sums in out.items()), key=repr)


def tables(spark, sales, lines, clicks):
    frames = [([(i, c, s, at(t)) for i, c, s, t in sales], SALES), ([(i, at(t)) for i, t in lines], LINES), ([(c, at(t), k) for c, t, k in clicks], CLICKS)]
    return [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in frames]


def made(seed, hours=3000, n=120, start=0):
    rng, hour = random.Random(seed), 3_600_000_000
    when = lambda: None if rng.random() < 0.03 else start + rng.randrange(hours * hour)
    client = lambda: rng.choice([7, 7, 7, 1, 2, 3, None])
    clicks, now = [], start
    for _ in range(n * 4):
        now += rng.choice([0, 1, 60, 299, 300, 300, 301, 3000, 90_000]) * 1_000_000 + rng.choice([0, 0, 1])
        clicks.append((rng.choice([7, 7, 1, None]), now if rng.random() > 0.03 else None, rng.choice(["click", "view", None])))
    clicks += rng.sample(clicks, 30)
    sales = [(k, client(), rng.choice(["held", "done", "open", None]), when()) for k in range(n)] + [(None, 7, "done", start), (5, 7, "open", start + hour)]
    lines = [(rng.choice([None, *range(n)]), when()) for _ in range(2 * n)]
    return sales, lines, clicks


@pytest.mark.parametrize("seed,start", [(1, 0), (2, 1_704_067_200_000_000), (3, -3_000_000_000_000_000)])
def test_sessions(spark, seed, start):
    _, _, clicks = made(seed, start=start)
    found = [tuple(r) for r in ij.sessions(tables(spark, [], [], clicks)[2]).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_sessions(clicks, ij.GAP)


def test_long_sessions(spark):
    """Clicks every 299, 300 or 301 seconds over days: sessions cross spans and blocks of spans."""
    clicks = [(c, k * step * 1_000_000, "click" if k % 2 else "view") for c, step in ((1, 299), (2, 300), (3, 301), (4, 86_399)) for k in range(900)]
    found = {tuple(r) for r in ij.sessions(tables(spark, [], [], clicks)[2]).collect()}
    assert found == plain_sessions(clicks, ij.GAP)
    assert sum(c == 1 for c, *_ in found) == 1 and sum(c == 3 for c, *_ in found) == 900


@pytest.mark.parametrize("seed,start", [(4, 0), (5, 1_704_067_200_000_000), (6, -3_000_000_000_000_000)])
def test_join(spark, seed, start):
    given = made(seed, start=start)
    found = sorted((tuple(r) for r in ij.sales_and_sessions(*tables(spark, *given)).collect()), key=repr)
    assert found == plain_join(*given) and len({r[1] for r in found}) >= 7


def test_zone_and_clashing_names(spark):
    """Times without a zone do not follow the session's zone; columns of other names do not matter."""
    given = made(8, start=1_710_000_000_000_000)
    names = "start end bucket n weight row_key first last open at block span away relation until shipped latest".split()
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        frames = [df.withColumns({c: F.lit(1) for c in names}) for df in tables(spark, *given)]
        found = sorted((tuple(r) for r in ij.sales_and_sessions(*frames).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == plain_join(*given)


def test_empty_tables(spark):
    sales, lines, clicks = made(9)
    for given in (([], lines, clicks), (sales, lines, []), ([], [], [])):
        assert ij.sales_and_sessions(*tables(spark, *given)).count() == 0
    found = sorted((tuple(r) for r in ij.sales_and_sessions(*tables(spark, sales, [], clicks)).collect()), key=repr)
    assert found == plain_join(sales, [], clicks)


def test_other_slots(spark):
    given = made(10)
    found = sorted((tuple(r) for r in ij.sales_and_sessions(*tables(spark, *given), gap=ij.MINUTE, slot=7 * ij.DAY).collect()), key=repr)
    assert found == plain_join(*given, gap=ij.MINUTE, slot=7 * ij.DAY)


def test_query(spark, shop, small):
    assert compared(spark, shop, small, op12_interval_join, ORACLE_SQL["op12_interval_join"]) is None
