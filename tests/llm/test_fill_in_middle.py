"""Fill-in-the-middle against a plain version with patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fill_in_middle as fim
from palimpsest.llm.queries import op11_fill_in_middle
from palimpsest.llm.sql import ORACLE_SQL

from ..compare import compared

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text, seed=1, cut=90, suffix_first=20):
    text = text or ""
    units = UNIT.findall(text)
    h = fim.draws(doc_id, seed)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_text(rng, size):
    pieces = ["a", "Zq", "P", "S", "M", "<", ">", "<P", "S>", "é", "ß", "漢", "👍🏽", "\n", "\x00", " ", "é", "<S", "1"]
    return "".join(rng.choice(pieces) for _ in range(size))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_scan(block):
    """Units, sentinels and ends of units, wherever blocks end."""
    rng = random.Random(block)
    for size in [*range(12), 100, 300]:
        for _ in range(6):
            text = random_text(rng, size)
            scan, units = fim.Scan(text.encode(), block), UNIT.findall(text)
            assert scan.n == len(units)
            assert scan.sentinel == any(s in text for s in ("<P>", "<S>", "<M>"))
            ends = [len("".join(units[:k]).encode()) for k in range(scan.n + 1)]
            assert [scan.end(k) for k in range(scan.n + 1)] == ends


def test_rules_fix_the_state_by_two_classes():
    for first in range(6):
        for second in range(6):
            assert len({fim.step(fim.step(state, first)[0], second)[0] for state in range(4)}) == 1


def test_rows_and_restored_texts(spark):
    rng = random.Random(5)
    texts = [None, "", "<P>", "a<M>b", "x" * 200_000, "<" * 70_000, "漢字" * 40_000] + [random_text(rng, rng.randint(1, 400)) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no id"), (None, None), (9, texts[9])]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "restored", "id")})
    cuts = fim.restore(fim.transform(given))
    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in cuts.collect()), key=repr)
    assert found == sorted(((i, *plain(i, t), t or "") for i, t in rows), key=repr)
    assert {"plain", "psm", "spm"} == {x[2] for x in found}
    other = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.transform(given.where("doc_id IS NOT NULL"), seed=7, cut=50, suffix_first=50).collect()}
    assert other == {i: plain(i, t, 7, 50, 50) for i, t in rows if i is not None}
    assert fim.restore(fim.transform(given.limit(0))).count() == 0


def test_text_of_twenty_megabytes(spark):
    long_text = "some words, and 漢字 " * 1_000_000
    given = spark.range(1).select(F.lit(3).alias("doc_id"), F.lit(long_text).alias("text"))
    row = fim.restore(fim.transform(given)).first()
    assert row.restored == long_text and row.n == len(UNIT.findall(long_text)) and row.form != "plain"


def test_query(spark, shop, small):
    assert compared(spark, shop, small, op11_fill_in_middle, ORACLE_SQL["op11_fill_in_middle"]) is None
