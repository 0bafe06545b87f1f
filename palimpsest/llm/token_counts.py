"""Token counts by a compiled finite-state transducer.

A SentencePiece BPE model is compiled, as texts need it, into a deterministic
transducer over characters whose transitions carry emitted-token counts.

Why a state is finite. BPE of a prefix is known once its last token t is: what
precedes t is the BPE of the shorter prefix, and exactly one piece t that ends
there is *compatible* with the last token before it (BPE of the two joined
gives the two). So a state keeps, for each start from which a piece can still
grow (a path in the trie of pieces), the trie node, the last token before the
start, and how many tokens fewer there were; starts reach back no further than
the longest piece. A last token that cannot be merged across is kept as none.
Where two characters stand together in no piece, all states collapse to one.

Texts are cut into chunks, after such a collapse where there is one: there the
entry is known. Every other chunk gets a state map, entry -> (exit, count), for
the entries that the characters before the cut lead to from several distances
back. Maps are composed by a parallel prefix scan: in each of its rounds the
composition of 2^k chunks is joined to that of the next 2^k, so a text of n
chunks takes log2(n) rounds. Where a map lacks an entry that the chunk before it
exits with, the map is extended, for all such chunks at once, and scanned again.
All chunks of a batch run in step, one array operation for one character of each.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text

SPACE = "▁"
#: Characters of a chunk; a cut moves right, to a collapse of states, by as many at most.
CHUNK = 512
#: Characters before a cut from which the entries of a chunk's state map are found.
LOOK_BACK = (64, 40, 24)
#: Characters that run together; bounds memory beside the longest text.
TOGETHER = 6_000_000
#: Transitions kept; beyond them the table is built anew.
TRANSITIONS = 4_000_000


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> tuple[dict[str, float], bool]:
    """Pieces that texts can give, with their scores; whether a space is put before a text."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, prefix = {}, True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                pieces[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        elif number == 2:
            spec = dict(_fields(value))
            if spec.get(3, 1) != 2 or not spec.get(35, 0):
                raise ValueError("only BPE models with byte fallback are compiled")
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("only models that keep texts as they are, with spaces escaped, are compiled")
            prefix = bool(spec.get(3, 1))
    return pieces, prefix


class Transducer:
    """States and transitions, made when first needed. State 0 is the start (also after a character in no piece)."""

    def __init__(self, path: str):
        self.scores, self.prefix = read_model(path)
        self.names: list[str] = []
        self.token_of: dict[str, int] = {}
        self.children: list[dict[str, int]] = [{}]
        self.token_at: list[int] = [-1]
        characters = sorted({c for piece in self.scores for c in piece})
        for name in [*characters, *self.scores]:
            if name not in self.token_of:
                self.token_of[name] = len(self.names)
                self.names.append(name)
                node = 0
                for c in name:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.token_at.append(-1)
                    node = self.children[node][c]
                self.token_at[node] = self.token_of[name]
        self.weight = [1 if n in self.scores else len(n.encode()) for n in self.names]
        self.inner = {a + b for piece in self.scores for a, b in zip(piece, piece[1:])}
        if any(pair[1] == SPACE != pair[0] for pair in self.inner):
            raise ValueError("a piece has a space after another character")
        self.characters = characters
        self.class_of = np.full(0x110000, len(characters), dtype=np.int64)
        for low, shift in ((0x80, 1), (0x800, 2), (0x10000, 3)):
            self.class_of[low:] = len(characters) + shift
        self.class_of[[ord(c) for c in characters]] = np.arange(len(characters))
        self.n_classes = len(characters) + 4
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {(-1, ()): 0}
        self.listed: list[tuple] = [(-1, ())]
        self.used, self.bits = 0, 16
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)

    def bpe(self, text: str) -> list[str]:
        """BPE of a short text: the adjacent pair of highest score is joined, leftmost first."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, before: int, token: int) -> bool:
        if before < 0:
            return True
        key = (before, token)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > TRANSITIONS:
                self.fits.clear()
            a, b = self.names[before], self.names[token]
            found = self.fits[key] = self.bpe(a + b) == [a, b]
        return found

    def transition(self, state: int, kind: int) -> tuple[int, int]:
        """(next state, change of the token count)."""
        if kind >= len(self.characters):
            return 0, kind - len(self.characters) + 1
        c = self.characters[kind]
        last, starts = self.listed[state]
        fresh = -1 if last < 0 or self.names[last][-1] + c not in self.inner else last
        kept, found = [], None
        for node, before, fewer in (*starts, (0, fresh, 0)):
            child = self.children[node].get(c)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and found is None and self.compatible(before, token) and (len(self.names[token]) == 1 or self.bpe_is_one(token)):
                found = (token, fewer + self.weight[token])
            if self.children[child]:
                kept.append((child, before, fewer))
        token, change = found
        key = (token, tuple((node, before, fewer - change) for node, before, fewer in kept))
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.listed)
            self.listed.append(key)
        return number, change

    def bpe_is_one(self, token: int) -> bool:
        """Whether a piece is its own BPE (else it never is a token of a text)."""
        key = (-2, token)
        found = self.fits.get(key)
        if found is None:
            found = self.fits[key] = self.bpe(self.names[token]) == [self.names[token]]
        return found

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.used + len(keys)) * 2 > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while len(keys) * 2 > 1 << self.bits:
                self.bits += 1
            self.bits += 1
            self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
            self.values = np.zeros(1 << self.bits, dtype=np.int64)
            self.used = 0
        self.used += len(keys)
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            done = self.keys[slots] == keys
            self.values[slots[done]] = values[done]
            keys, values, slots = keys[~done], values[~done], (slots[~done] + 1) & mask

    def step(self, states: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states * self.n_classes + kinds
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        found = self.keys[slots]
        values = self.values[slots]
        open_at = np.flatnonzero(found != keys)
        while len(open_at):
            absent = found[open_at] < 0
            if absent.any():
                wanted = np.unique(keys[open_at[absent]])
                made = [self.transition(*divmod(k, self.n_classes)) for k in wanted.tolist()]
                self._insert(wanted, np.array([(s << 16) + c + 0x8000 for s, c in made], dtype=np.int64))
                slots[open_at], mask = self._slots(keys[open_at]), (1 << self.bits) - 1
            else:
                slots[open_at] = (slots[open_at] + 1) & mask
            found[open_at] = self.keys[slots[open_at]]
            values[open_at] = self.values[slots[open_at]]
            open_at = open_at[found[open_at] != keys[open_at]]
        return values >> 16, (values & 0xFFFF) - 0x8000

    def run(self, kinds: np.ndarray, begins: np.ndarray, lengths: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exits and counts of chunks of kinds, given by begin and length, from their entries."""
        order = np.argsort(-lengths, kind="stable")
        begins, left, states = begins[order], lengths[order], entries[order].astype(np.int64)
        counts = np.zeros(len(order), dtype=np.int64)
        n = len(order)
        for at in range(int(left[0]) if n else 0):
            n = int(np.searchsorted(-left[:n], -at, side="left"))
            states[:n], change = self.step(states[:n], kinds[begins[:n] + at])
            counts[:n] += change
        exits, totals = np.empty_like(states), np.empty_like(counts)
        exits[order], totals[order] = states, counts
        return exits, totals

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of tokens of whole texts."""
        if self.used > TRANSITIONS:
            self.reset()
        lead = SPACE if self.prefix else ""
        codes = np.frombuffer("".join([lead + t for t in texts if t]).replace(" ", SPACE).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) + len(lead) if t else 0 for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        space = codes == ord(SPACE)
        collapses = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        begins, heads, sure = [], [], []  # of chunks; the document's begin; whether the entry is the start state
        for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
            if begin == end:
                continue
            begins.append(begin)
            heads.append(begin)
            sure.append(True)
            at = begin + CHUNK
            while at < end:
                k = int(np.searchsorted(collapses, at))
                collapse = int(collapses[k]) if k < len(collapses) else end
                known = collapse < at + CHUNK
                at = collapse if known else at + CHUNK
                if at >= end:
                    break
                begins.append(at)
                heads.append(begin)
                sure.append(known)
                at += CHUNK
        kinds = self.class_of[codes]
        begins, heads, sure = np.array(begins, dtype=np.int64), np.array(heads, dtype=np.int64), np.array(sure, dtype=bool)
        lengths = np.diff(np.append(begins, len(codes)))
        totals = self.scanned(kinds, begins, heads, lengths, sure)
        edge = np.searchsorted(begins[sure], np.concatenate([[0], ends]))
        return np.diff(np.concatenate([[0], np.cumsum(totals)])[edge]).tolist()

    def entries(self, kinds: np.ndarray, begins: np.ndarray, heads: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Keys (chunk << 32 | state) of the state maps' first entries."""
        open_chunks = np.flatnonzero(~sure)
        keys = [np.flatnonzero(sure) << 32]
        for far in LOOK_BACK if len(open_chunks) else ():
            back = np.minimum(far, begins[open_chunks] - heads[open_chunks])
            keys.append(open_chunks << 32 | self.run(kinds, begins[open_chunks] - back, back, np.zeros(len(open_chunks), dtype=np.int64))[0])
        return np.unique(np.concatenate(keys))

    def scanned(self, kinds: np.ndarray, begins: np.ndarray, heads: np.ndarray, lengths: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Counts of each run of chunks from one known entry to the next, by a prefix scan over state maps."""
        last = np.append(sure[1:], True) if len(sure) else sure
        runs = np.cumsum(sure) - 1
        first = np.flatnonzero(sure) << 32
        known = exits = counts = np.empty(0, dtype=np.int64)
        fresh = self.entries(kinds, begins, heads, sure)
        while True:
            # the maps' rows, in the order of chunk and entry
            more = self.run(kinds, begins[fresh >> 32], lengths[fresh >> 32], fresh & 0xFFFFFFFF)
            known, exits, counts = np.concatenate([known, fresh]), np.concatenate([exits, more[0]]), np.concatenate([counts, more[1]])
            order = np.argsort(known, kind="stable")
            known, exits, counts = known[order], exits[order], counts[order]
            n, chunk = len(known), known >> 32
            follows = chunk + 1 << 32 | exits
            at = np.minimum(np.searchsorted(known, follows), max(n - 1, 0))
            there = known[at] == follows if n else np.empty(0, dtype=bool)
            # row n is a run's end, row n + 1 an entry that the next map lacks
            jump = np.concatenate([np.where(last[chunk], n, np.where(there, at, n + 1)), [n, n + 1]])
            composed = np.concatenate([counts, [0, 0]])
            while (jump[:n] < n).any():
                composed, jump = composed + composed[jump], jump[jump]
            rows = np.searchsorted(known, first)
            lost = jump[rows] == n + 1
            if not lost.any():
                return composed[rows]
            fresh = np.unique(follows[~there & ~last[chunk] & lost[runs[chunk]]])


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker process; it keeps what it has compiled."""
    return Transducer(path)


class CountTask:
    def __init__(self, path: str, limit: int):
        self.machine, self.limit = transducer(path), limit

    def __call__(self, batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        counts, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                counts += self.machine.counts(group)
                group, size = [], 0
        counts += self.machine.counts(group)
        return {"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": counts, "over_limit": [n > self.limit for n in counts]}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text.

    Null and empty texts have no tokens. Repeated rows stay, null ids too; other
    columns are ignored, whatever their names; an empty table gives no row.
    """
    text = whole_text(text_column)
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return map_arrow(given, lambda: CountTask(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
