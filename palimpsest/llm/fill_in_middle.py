"""Fill-in-the-middle rearrangement of texts by a table-driven scan of their bytes.

A unit is a run of ASCII letters or one other code point. An automaton over the
classes of UTF-8 bytes tells unit boundaries, continuation bytes and the three
sentinels apart in one scan. Its transitions carry what they emit: 1 where a byte
begins a unit, and a mark where it completes a sentinel. The state after a byte is
fixed by that byte's class and the one before (the tables are built from the rules
and checked for this), so that a scan is a few table look-ups over whole blocks of
bytes, with two classes carried from block to block.

The first pass keeps the number of units of each block. The second pass finds the
two cuts: the block by the running count, the byte by the transitions of that block
alone. So a text needs the memory of one block beside its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of the documents that can be cut, hundredths that are; of those, hundredths whose suffix comes first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of a block.
BLOCK = 1 << 16

#: Classes of bytes: what begins a unit by itself, letters, letters of sentinels, what opens and closes those, continuation bytes.
OTHER, LETTER, NAMED, OPENS, CLOSES, CONTINUED = range(6)
#: States: outside letters, within letters, after an opening, after an opening and a sentinel's letter.
OUTSIDE, WITHIN, OPENED, SPELT = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
CLASS[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = NAMED
CLASS[ord("<")], CLASS[ord(">")], CLASS[0x80:0xC0] = OPENS, CLOSES, CONTINUED


def step(state: int, kind: int) -> tuple[int, int, bool]:
    """The rules: next state, units that begin, whether a sentinel ends, for one byte's class."""
    if kind == CONTINUED:
        return OUTSIDE, 0, False
    if kind in (LETTER, NAMED):
        to = SPELT if kind == NAMED and state == OPENED else WITHIN
        return to, int(state not in (WITHIN, SPELT)), False
    return (OPENED if kind == OPENS else OUTSIDE), 1, kind == CLOSES and state == SPELT


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State after two classes; units and sentinels of (state, class)."""
    after = np.zeros((6, 6), np.uint8)
    for before in range(6):
        for kind in range(6):
            ends = {step(step(state, before)[0], kind)[0] for state in range(4)}
            if len(ends) > 1:
                raise AssertionError("two classes do not fix the state")
            after[before, kind] = ends.pop()
    each = [[step(state, kind) for kind in range(6)] for state in range(4)]
    return after.ravel() * 6, np.array([[x[1] for x in row] for row in each], np.uint8).ravel(), np.array([[x[2] for x in row] for row in each]).ravel()


AFTER, UNITS, FOUND = _tables()


class Scan:
    """One text's bytes: n units, whether a sentinel occurs, and where the k-th unit ends."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.bytes, self.block = np.frombuffer(data, np.uint8), block
        counts, self.sentinel = [], False
        for at in range(0, len(data), block):
            moves = self._moves(at)
            counts.append(int(UNITS[moves].sum()))
            self.sentinel = self.sentinel or bool(FOUND[moves].any())
        self.counts = np.cumsum([0, *counts])
        self.n = int(self.counts[-1])

    def _moves(self, at: int) -> np.ndarray:
        """(state, class) of each byte of the block at `at`; a text begins as after a byte outside letters."""
        kinds = CLASS[self.bytes[max(0, at - 2) : at + self.block]]
        if at < 2:
            kinds = np.concatenate([np.full(2 - at, OTHER, np.uint8), kinds])
        return AFTER[kinds[:-2] * 6 + kinds[1:-1]] + kinds[2:]

    def end(self, k: int) -> int:
        """Bytes of the first k units."""
        if k == self.n:
            return len(self.bytes)
        of = int(np.searchsorted(self.counts, k, side="right")) - 1
        begins = np.flatnonzero(UNITS[self._moves(of * self.block)])
        return of * self.block + int(begins[k - int(self.counts[of])])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 of a document's id."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(doc_id: int | None, text: str, seed: int, cut: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    data = text.encode()
    scan = Scan(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or scan.sentinel or h3 % 100 >= cut:
        return scan.n, "plain", None, None, text
    low, high = sorted((h1 % (scan.n + 1), h2 % (scan.n + 1)))
    a, b = scan.end(low), scan.end(high)
    prefix, middle, suffix = (x.decode() for x in (data[:a], data[a:b], data[b:]))
    if h4 % 100 < suffix_first:
        return scan.n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return scan.n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def original(output: str, form: str) -> str:
    """The text of an output. No part holds a sentinel, and none can arise where a part meets one."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, end = output.index(second), output.index(MIDDLE)
    parts = {first: output[len(first) : at], second: output[at + len(second) : end]}
    return parts[PREFIX] + output[end + len(MIDDLE) :] + parts[SUFFIX]


class CutTask:
    def __init__(self, *how: int):
        self.how = how

    def __call__(self, batch: pa.RecordBatch) -> dict:
        rows = [rearranged(i.as_py(), t.as_py(), *self.how) for i, t in zip(*batch.columns[:2])]
        made = zip(*rows) if rows else [[]] * 5
        return {"doc_id": batch.column(0)} | dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), map(list, made)))


class RestoreTask:
    def __call__(self, batch: pa.RecordBatch) -> dict:
        back = [None if (o := output.as_py()) is None else original(o, form.as_py()) for form, output in zip(batch.column("form"), batch.column("output"))]
        return dict(zip(batch.schema.names, batch.columns)) | {"restored": back}


CUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output.

    Two cuts after a number of units drawn from the id and the seed; of the texts
    that can be cut, `cut` hundredths are, and `suffix_first` hundredths of those
    have their suffix first. Empty texts, null ones (they count as empty) and texts
    that hold a sentinel stay plain. A null id draws as an id without digits;
    repeated rows get equal outputs; other columns are ignored, whatever their names;
    an empty table gives no row. Long texts are scanned in blocks.
    """
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return map_arrow(given, lambda: CutTask(seed, cut, suffix_first), CUTS)


def restore(cuts: DataFrame) -> DataFrame:
    """The rows of transform() with `restored`, the text rebuilt from output and form alone."""
    return map_arrow(cuts.select(*[c.split()[0] for c in CUTS.split(", ")]), RestoreTask, f"{CUTS}, restored string")


def digests(restored: DataFrame) -> DataFrame:
    """restore()'s rows with output_sha256 and restored_sha256 in place of the texts."""
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
