"""Similarity join of documents by Jaccard on word n-grams, exactly, to classes.

1. Sets. A text's words are hashed from one running sum over its bytes, n-grams
   from the words' hashes, all by array operations; the distinct n-grams are a
   sorted array of 64-bit numbers. Equal sets are one node from here on.
2. Tiles. Sizes are cut into bands; tile i holds the sets of band i and all
   larger sets that can link to one of them. Two linked sets of tile i differ in
   at most D_i elements, so of D_i + 1 + s parts of the hash range at least
   s + 1 are equal in both. Each set sends one signature per part (sum of mixed
   elements), leaving out its smallest parts, at most s of them: the set that
   leaves out the larger ones leaves out s at most, so an equal part that both
   send remains. Sets that share a signature are chained to the least of them,
   and the groups that result (candidate groups) hold every link.
3. Exact links. A candidate group is split into tiles by size band and hash,
   each of bounded size; a task compares two tiles. Parity bitmaps of hashed
   elements bound every overlap from above by the count of differing bits; what
   may still link is intersected exactly. A task emits a spanning forest only.
4. Components of the links; each document gets its set's component.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, stored, whole_text
from .components import components

#: Ratio of neighbouring size bands.
BAND = 1.25
#: Sets of a tile, and distinct n-grams that its largest size may stand for.
TILE_SETS, TILE_ELEMENTS = 512, 1_500_000
#: Names of sets that a task has sent already; emptied when full.
SENT_ENTRIES = 500_000
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
M64 = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93


def mix(z: np.ndarray, salt: int = 0) -> np.ndarray:
    """A mixing bijection of 64-bit numbers (splitmix64)."""
    z = z + np.uint64((salt * 2 + 1) * STEP & M64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 11)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_WHITE = np.isin(np.arange(256), list(WHITE))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k below n, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


#: Bytes whose running sum is taken at once.
SPAN = 1 << 20


def ngram_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: of fewer words the whole sequence, of no word nothing."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode().translate(LOWER) + b" "
        group.append(data)
        size += len(data)
        if size >= SPAN:
            out += _sets(group, words)
            group, size = [], 0
    return out + (_sets(group, words) if group else [])


def _sets(group: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(group), dtype=np.uint8)
    ends = np.cumsum([len(g) for g in group])
    n = max(2 * SPAN, 1 << int(len(data) + 1).bit_length())  # one size but for very long texts
    white = IS_WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(data) and not white[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[0::2], edge[1::2]  # each text ends in white space, so words do too
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_VALUES[data] * _powers(n, BASE)[: len(data)], dtype=np.uint64)])
    # the sum over a word divided by the power at its start does not depend on where it stands
    hashes = mix((sums[stops] - sums[starts]) * _powers(n, pow(BASE, -1, 1 << 64))[starts], 1)
    grams = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        grams[: len(hashes) - k] += mix(hashes[k:], 2 + k)
    grams = mix(grams, 40)
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            found = np.sort(grams[a : b - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            parts = np.concatenate([mix(hashes[a + k : a + k + 1], 60 + k) for k in range(b - a)])
            out.append(mix(parts.sum(dtype=np.uint64, keepdims=True), 59 - (b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_name(elements: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = int(mix(elements, 90).sum(dtype=np.uint64)) + len(elements) * STEP
    return int(mix(np.array([total & M64], dtype=np.uint64), 91).view(np.int64)[0])


@dataclass(frozen=True)
class Tile:
    low: int
    high: int
    difference: int
    slack: int

    @property
    def parts(self) -> int:
        return self.difference + 1 + self.slack


@dataclass(frozen=True)
class Rule:
    """Sets link when of * overlap >= at_least * union (of = 100, at_least = 90: Jaccard 0.9)."""

    words: int
    at_least: int
    of: int = 100

    def tile(self, band: int) -> Tile:
        low, after = band_start(band), band_start(band + 1)
        # with sizes a <= b: a >= t b, and the difference is at most a (1 - t) / t
        difference = (after - 1) * (self.of - self.at_least) // self.at_least
        return Tile(low, (after - 1) * self.of // self.at_least, difference, difference // 2)

    def tiles(self, size: int) -> list[tuple[int, Tile]]:
        """(band, tile) of the tiles of a set in which a set other than itself can link to it."""
        band, found = band_of(size), []
        while band >= 0:
            tile = self.tile(band)
            if tile.high < size:
                break
            if tile.difference:
                found.append((band, tile))
            band -= 1
        return found

    def least_overlap(self, a, b):
        """Smallest overlap at which sets of these sizes link."""
        return -(-(self.at_least * (a + b)) // (self.of + self.at_least))


@lru_cache(maxsize=1)
def _band_starts() -> list[int]:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    return starts


def band_start(band: int) -> int:
    return _band_starts()[band]


def band_of(size: int) -> int:
    return int(np.searchsorted(_band_starts(), size, side="right")) - 1


@lru_cache(maxsize=512)
def _borders(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)


def signatures(elements: np.ndarray, rule: Rule) -> np.ndarray:
    """Signatures of a set in all its tiles, as signed 64-bit numbers."""
    out = []
    mixed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(elements, 70), dtype=np.uint64)])
    for band, tile in rule.tiles(len(elements)):
        cuts = np.concatenate([[0], np.searchsorted(elements, _borders(tile.parts)), [len(elements)]])
        sizes = np.diff(cuts)
        # the largest c such that at most `slack` parts have c elements or fewer
        at_most = np.cumsum(np.bincount(sizes))
        least = int(np.searchsorted(at_most, tile.slack, side="right"))
        sent = np.flatnonzero(sizes >= least)
        sums = mixed[cuts[1:]] - mixed[cuts[:-1]]
        out.append(mix(sums[sent] + mix(sent.astype(np.uint64), 1000 + band), 71))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


class SetTask:
    """node (null: empty set) and size of each document."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def __call__(self, batch: pa.RecordBatch) -> dict:
        sets = ngram_sets(batch.column(1).to_pylist(), self.rule.words)
        return {"doc_id": batch.column(0), "n_shingles": [len(s) for s in sets], "node": [set_name(s) if len(s) else None for s in sets]}


class ElementsTask:
    """The sorted set of each text beside the places that need it: TILE_ELEMENTS bounds its bytes, not those of a text that repeats itself."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def __call__(self, batch: pa.RecordBatch) -> dict:
        return {"places": batch.column(0), "elements": [s.tobytes() for s in ngram_sets(batch.column(1).to_pylist(), self.rule.words)]}


class SignatureTask:
    def __init__(self, rule: Rule):
        self.rule, self.sent = rule, set()

    def __call__(self, batch: pa.RecordBatch) -> dict | None:
        nodes, found = [], []
        for s in ngram_sets(batch.column(0).to_pylist(), self.rule.words):
            if not len(s) or (name := set_name(s)) in self.sent:
                continue
            if len(self.sent) >= SENT_ENTRIES:
                self.sent.clear()
            self.sent.add(name)
            signs = signatures(s, self.rule)
            nodes.append(np.full(len(signs), name, dtype=np.int64))
            found.append(signs)
        return {"sign": np.concatenate(found), "node": np.concatenate(nodes)} if found else None


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity bitmaps: bit x is the parity of the number of elements that hash to x."""
    out = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    for row, s in zip(out, sets):
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        row[:] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def linked_pairs(sets: list[np.ndarray], rule: Rule, n_first: int):
    """Spanning forest (pairs of indices) of the links within sets, or between the first n_first and the others if those are fewer than all."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    n = len(sets)
    rows = range(n_first)
    bits = 512
    while bits < 65536 and bits < 4 * sizes.max(initial=1) * (rule.of - rule.at_least) // rule.at_least:
        bits *= 2
    maps = bitmaps(sets, bits)
    forest, out = Forest(n), []
    dense = None
    for a in rows:
        others = np.arange(a + 1, n) if n_first == n else np.arange(n_first, n)
        least = rule.least_overlap(sizes[a], sizes[others])
        others = others[(np.minimum(sizes[a], sizes[others]) >= least) & (sizes[others] > 0)]
        if not len(others) or not sizes[a]:
            continue
        differ = np.bitwise_count(maps[others] ^ maps[a]).sum(axis=1, dtype=np.int64)
        least = rule.least_overlap(sizes[a], sizes[others])
        others = others[(sizes[a] + sizes[others] - differ) // 2 >= least]
        mine = forest.root(a)
        others = [b for b in others.tolist() if forest.root(b) != mine]
        if len(others) > 8:
            if dense is None:
                dense = Incidence(sets)
            overlaps = dense.overlaps(a, np.array(others))
        else:
            overlaps = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in others]
        for b, overlap in zip(others, overlaps):
            if overlap >= rule.least_overlap(int(sizes[a]), int(sizes[b])) and forest.join(a, b):
                out.append((a, b))
    return out


class Incidence:
    """Overlaps of one set with many: elements of all sets are numbered once, a set is marked, counts are summed per set."""

    def __init__(self, sets: list[np.ndarray]):
        _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum([len(s) for s in sets])
        self.starts = self.ends - np.array([len(s) for s in sets])
        self.numbers = numbers
        self.marked = np.zeros(int(numbers.max(initial=0)) + 1, dtype=bool)

    def overlaps(self, a: int, others: np.ndarray) -> list[int]:
        own = self.numbers[self.starts[a] : self.ends[a]]
        self.marked[own] = True
        found = [int(np.count_nonzero(self.marked[self.numbers[self.starts[b] : self.ends[b]]])) for b in others.tolist()]
        self.marked[own] = False
        return found


def _links(rule: Rule):
    def run(group: pa.Table) -> pa.Table:
        # one row per set of a pair of tiles; side 0 is the first tile, equal tiles have side 0 only
        rows = group.select(["side", "node", "elements"]).sort_by([("side", "ascending"), ("node", "ascending")]).to_pydict()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["elements"]]
        first = rows["side"].count(0)
        pairs = linked_pairs(sets, rule, first)
        return pa.table({"a": pa.array([rows["node"][a] for a, _ in pairs], pa.int64()), "b": pa.array([rows["node"][b] for _, b in pairs], pa.int64())})

    return run


def document_sets(docs: DataFrame, rule: Rule, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return stored(map_arrow(given, lambda: SetTask(rule), "doc_id long, n_shingles long, node long"), "sets")


def candidate_groups(docs: DataFrame, rule: Rule, text_column: str = "text") -> DataFrame:
    """node, group of all sets that share a signature with another one."""
    signs = map_arrow(docs.select(whole_text(text_column).alias("text")), lambda: SignatureTask(rule), "sign long, node long")
    # rows of a signature are streamed in order: a running minimum holds no group in memory
    chained = signs.select("node", F.min("node").over(W.partitionBy("sign").orderBy("node").rowsBetween(W.unboundedPreceding, 0)).alias("least"))
    return stored(components(chained.where("node != least"), "node", "least").withColumnRenamed("component", "group"), "groups")


def links(docs: DataFrame, sets: DataFrame, rule: Rule, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """a, b: a spanning forest of the exact links between different sets, per pair of tiles."""
    groups = candidate_groups(docs, rule, text_column)
    # one document stands for each set
    stands = sets.where(F.col("node").isNotNull()).join(groups, "node").groupBy("node", "group").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    bands = F.floor(F.log(BAND, F.col("size").cast("double")) + 1e-9).cast("int")
    members = stored(stands.withColumn("band", bands), "members")
    whole = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("size").alias("elements")).withColumn("small", (F.col("sets") <= TILE_SETS) & (F.col("elements") <= TILE_ELEMENTS))
    kinds = members.join(whole.select("group", "small"), "group").withColumn("band", F.when(F.col("small"), -1).otherwise(F.col("band")))
    counts = kinds.groupBy("group", "band").agg(F.count("*").alias("sets"), F.sum("size").alias("elements"))
    tiles = counts.withColumn("tiles", F.when(F.col("band") < 0, 1).otherwise(F.ceil(F.greatest(F.col("sets") / (TILE_SETS // 2), F.col("elements") / (TILE_ELEMENTS // 2))))).select("group", "band", F.col("tiles").cast("int"))
    tiles = stored(tiles, "tiles")
    placed = kinds.join(tiles, ["group", "band"]).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).select("node", "doc_id", "group", "band", "tile")
    each = tiles.select("group", "band", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    reach = int(np.ceil(np.log(rule.of / rule.at_least) / np.log(BAND))) + 1
    one, two = each.alias("x"), each.alias("y")
    after = (F.col("y.band") > F.col("x.band")) | ((F.col("y.band") == F.col("x.band")) & (F.col("y.tile") >= F.col("x.tile")))
    pairs = one.join(two, (F.col("x.group") == F.col("y.group")) & after & (F.col("y.band") - F.col("x.band") <= reach))
    pairs = pairs.select(F.col("x.group").alias("group"), *[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "xy" for c in ("band", "tile")])
    key = F.xxhash64("group", "x_band", "x_tile", "y_band", "y_tile").alias("pair")
    same = (F.col("x_band") == F.col("y_band")) & (F.col("x_tile") == F.col("y_tile"))
    sides = pairs.select(key, F.lit(0).alias("side"), "group", F.col("x_band").alias("band"), F.col("x_tile").alias("tile"))
    sides = sides.union(pairs.where(~same).select(key, F.lit(1), "group", "y_band", "y_tile"))
    work = placed.join(sides, ["group", "band", "tile"]).select("pair", "side", "node", "doc_id")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    # each text is read and made a set once, however many pairs of tiles need it: the sets are what is exchanged
    needed = work.groupBy("doc_id").agg(F.collect_list(F.struct("pair", "side", "node")).alias("places"))
    made = map_arrow(needed.join(texts, "doc_id").select("places", "text"), lambda: ElementsTask(rule), "places array<struct<pair: bigint, side: int, node: bigint>>, elements binary")
    rows = made.select(F.explode("places").alias("p"), "elements").select("p.pair", "p.side", "p.node", "elements")
    return rows.groupBy("pair").applyInArrow(_links(rule), "a long, b long")


def classes(docs: DataFrame, words: int = 3, at_least: int = 90, of: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are what white space (space, tab to carriage return) separates, with
    A-Z lower-cased; a set is the distinct n-grams of `words` words, of a shorter
    text the whole sequence. Two documents link when of * overlap >= at_least *
    union. component_id is the smallest id reachable. Null and empty texts and
    texts without words have size 0 and are linked with nothing. Rows are
    documents; ids are taken to be unique, rows that repeat an id and its text
    come back as often. An empty table gives no row; other columns are ignored.
    """
    rule = Rule(words, at_least, of)
    sets = document_sets(docs, rule, id_column, text_column)
    found = components(links(docs, sets, rule, id_column, text_column))
    named = stored(sets.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("class")), "classes")
    # classes of one document need no join: only those of several are looked up
    several = stored(named.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    return named.join(several, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, at_least: int = 80, of: int = 100) -> DataFrame:
    """The documents without those that are not the first (smallest id) of their class.

    Columns of any name stay as they are. Null and empty texts and null ids stay;
    rows that repeat an id and its text go or stay together; an empty table stays empty.
    """
    others = stored(classes(docs, words, at_least, of).where("component_id != doc_id").select("doc_id").distinct(), "others")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(others.withColumnRenamed("doc_id", "id"), "id", "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
