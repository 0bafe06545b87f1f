"""Content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of its last ids says so,
so equal passages give equal chunks wherever they stand. A chunk is stored once,
under its SHA-256. A document is a recipe: the ordered names of its chunks and
their Merkle root. One exchange deals chunks by name; texts are never moved.

Files of a store (Parquet): `parts/kind=chunk` (name, n_ids, data),
`recipes` (in ascending id order; part, row, local_start, n_ids, chunks, root),
`offsets` (ids before each part) and `format` (bytes of an id). Chunk data are
little-endian unsigned integers of 2 bytes where the vocabulary allows, else 4.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import fresh_path, map_arrow, whole_text

WINDOW, MIN_IDS, MAX_IDS, MASK_BITS = 16, 128, 4096, 9
#: Names of chunks that a task has sent already; emptied when full.
SENT_ENTRIES = 200_000
PARTS = "kind string, name binary, doc_id long, n_ids long, data binary, chunks array<binary>, root binary"


def _mixed(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each id (splitmix64)."""
    z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


MIXED = _mixed(1 << 16)


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: where the rolling hash of the last WINDOW ids has MASK_BITS zero bits, within the limits."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n] if n else []
    total = np.cumsum(MIXED[ids & np.uint32(0xFFFF)] if ids.dtype.itemsize > 2 else MIXED[ids], dtype=np.uint64)
    rolling = total.copy()
    rolling[WINDOW:] -= total[:-WINDOW]
    marks = np.flatnonzero((rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MASK_BITS) == 0) + 1
    ends, last = [], 0
    for mark in marks.tolist():
        while mark - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if mark - last >= MIN_IDS:
            last = mark
            ends.append(last)
    while n - last > MAX_IDS:
        last += MAX_IDS
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def merkle_root(names: list[bytes]) -> bytes:
    """Root over chunk names; leaves and inner nodes are hashed apart, an odd node moves up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in names]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() for k in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else hashlib.sha256(b"").digest()


POLY = 0xEDB88320


def _product(a: int, b: int) -> int:
    """a times b modulo the CRC-32 polynomial, bits reflected."""
    m, p = 1 << 31, 0
    while a:
        if a & m:
            p ^= b
            a ^= m
        m >>= 1
        b = b >> 1 ^ POLY if b & 1 else b >> 1
    return p


class Combine:
    """crc32 of joined byte strings from the crc32 and length of each."""

    def __init__(self):
        self.shifts: dict[int, int] = {0: 1 << 31}

    def shift(self, n: int) -> int:
        """x^(8 n) modulo the polynomial."""
        if n not in self.shifts:
            value, power, left = 1 << 31, 1 << 23, n
            while left:
                if left & 1:
                    value = _product(power, value)
                power, left = _product(power, power), left >> 1
            self.shifts[n] = value
        return self.shifts[n]

    def __call__(self, first: int, second: int, second_bytes: int) -> int:
        return _product(self.shift(second_bytes), first) ^ second


class ChunkTask:
    """Rows of chunks (each sent once by a task as far as it remembers) and of recipes."""

    def __init__(self, path: str, end_id: int):
        self.encoder = bpe.word_bpe(path)
        self.end = np.array([end_id], dtype=self.encoder.dtype).tobytes()
        self.sent: set[bytes] = set()
        self.rows = 0

    def __call__(self, batch: pa.RecordBatch) -> dict:
        out = []
        size = self.encoder.dtype.itemsize
        for document, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = self.encoder.encode(text.as_py()) + self.end
            ids = np.frombuffer(data, dtype=self.encoder.dtype)
            names, start = [], 0
            for end in cut(ids):
                piece = data[start * size : end * size]
                name = hashlib.sha256(piece).digest()
                if name not in self.sent:
                    if len(self.sent) >= SENT_ENTRIES:
                        self.sent.clear()
                    self.sent.add(name)
                    out.append(("chunk", name, None, end - start, piece, None, None))
                names.append(name)
                start = end
            self.rows += 1
            spread = hashlib.blake2b(struct.pack("<qq", document or 0, self.rows), digest_size=8).digest()
            out.append(("recipe", spread, document, len(ids), None, names, merkle_root(names)))
        names = ("kind", "name", "doc_id", "n_ids", "data", "chunks", "root")
        return dict(zip(names, zip(*out, strict=True), strict=True)) if out else None


def _once(batches):
    """Of each chunk name of a partition the first row; recipes as they come."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keep.append(kind == "recipe" or name not in seen)
            if kind == "chunk":
                seen.add(name)
        yield batch.filter(pa.array(keep))


class OrderTask:
    """Local starts of a partition's recipes, in the order in which they come."""

    def __init__(self):
        self.row = self.start = 0

    def __call__(self, batch: pa.RecordBatch) -> dict:
        rows, starts = [], []
        for n in batch.column(1).to_pylist():
            rows.append(self.row)
            starts.append(self.start)
            self.row, self.start = self.row + 1, self.start + n
        return {"doc_id": batch.column(0), "n_ids": batch.column(1), "chunks": batch.column(2), "root": batch.column(3), "row": rows, "local_start": starts}


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the store of all documents' ids, each stream followed by end_id.

    Null texts count as empty and have the one id end_id. Repeated rows have
    recipes of their own. An empty table gives a store without rows. Columns other
    than the id and the text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    # written first, so that a store without it was never begun
    spark.createDataFrame([(bpe.word_bpe(tokenizer).dtype.itemsize,)], "id_bytes int").coalesce(1).write.parquet(f"{path}/format")
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    rows = map_arrow(given, lambda: ChunkTask(tokenizer, end_id), PARTS)
    rows.repartition("name").mapInArrow(_once, PARTS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    recipes = _parts(spark, path, "recipe").select("doc_id", "n_ids", "chunks", "root")
    ordered = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    numbered = map_arrow(ordered, OrderTask, "doc_id long, n_ids long, chunks array<binary>, root binary, row long, local_start long").withColumn("part", F.spark_partition_id())
    numbered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    # one row per part: their number is bounded by that of the partitions
    totals = read_recipes(spark, path).groupBy("part").agg(F.sum("n_ids").alias("ids"), F.min("doc_id").alias("first"))
    before = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    totals.select("part", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{path}/offsets")


def _parts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(f"{path}/parts").where(F.col("kind") == kind)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_ids long, chunks array<binary>, root binary, row long, local_start long, part int").parquet(f"{path}/recipes")


def id_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of an id in the chunks of a store."""
    return spark.read.schema("id_bytes int").parquet(f"{path}/format").first().id_bytes


class FactsTask:
    """Checks each stored chunk against its name; gives its length and the crc32 of its ids as 32-bit integers."""

    def __init__(self, size: int):
        self.dtype = np.dtype(f"<u{size}")

    def __call__(self, batch: pa.RecordBatch) -> dict:
        names, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids = [np.frombuffer(x, dtype=self.dtype).astype("<u4").tobytes() for x in data]
        return {"name": names, "n": [len(x) // 4 for x in ids], "crc": [zlib.crc32(x) for x in ids], "good": [hashlib.sha256(x).digest() == n for n, x in zip(names, data)]}


class DocumentTask:
    """A document's length and crc32 from its chunks' facts, and its Merkle root against the manifest."""

    def __init__(self):
        self.combine = Combine()

    def __call__(self, batch: pa.RecordBatch) -> dict:
        counts, crcs, good = [], [], []
        for facts, root in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            n = crc = 0
            for k, x in enumerate(y for y in facts if y["n"] is not None):  # a missing chunk has no facts
                crc = self.combine(crc, x["crc"], x["n"] * 4) if k else x["crc"]
                n += x["n"]
            counts.append(n)
            crcs.append(crc)
            good.append(all(x["good"] for x in facts) and merkle_root([x["name"] for x in facts]) == root)
        return {"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": counts, "ids_crc32": crcs, "verified": good}


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified of every document, from the files of a store.

    Chunks are read and checked once each; a document's crc32 is combined from
    those of its chunks in recipe order, so no chunk data are exchanged. Documents
    with a chunk that is missing or not as named are not verified; their counts are
    those of the chunks that are there. A store of no documents gives no row.
    """
    size = id_bytes(spark, path)
    facts = map_arrow(_parts(spark, path, "chunk").select("name", "data"), lambda: FactsTask(size), "name binary, n long, crc long, good boolean")
    recipes = read_recipes(spark, path)
    offsets = F.broadcast(spark.read.schema("part int, before long").parquet(f"{path}/offsets"))
    rows = recipes.select("part", "row", F.posexplode("chunks").alias("pos", "name"))
    lists = rows.join(facts, "name", "left").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "n", "crc", F.coalesce("good", F.lit(False)).alias("good")))).alias("facts"))
    whole = recipes.drop("chunks").join(offsets, "part").join(lists, ["part", "row"])
    return map_arrow(whole.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "facts", "root"), DocumentTask, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids array<long>: every document whose chunks are all there, rebuilt from its recipe."""
    size = id_bytes(spark, path)
    chunks = _parts(spark, path, "chunk").select("name", "data")
    rows = read_recipes(spark, path).select("doc_id", "part", "row", F.size("chunks").alias("n"), F.posexplode("chunks").alias("pos", "name"))
    lists = rows.join(chunks, "name").groupBy("part", "row", "n").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("pos", "data"))).alias("pieces")).where(F.size("pieces") == F.col("n"))

    class Rebuild:
        def __call__(self, batch: pa.RecordBatch) -> dict:
            join = lambda x: np.frombuffer(b"".join(p["data"] for p in x), dtype=f"<u{size}").tolist()
            return {"doc_id": batch.column(0), "ids": [join(x) for x in batch.column(1).to_pylist()]}

    return map_arrow(lists.select("doc_id", "pieces"), Rebuild, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes a fresh store in the shared folder and returns read_digests() of it. Nulls, repeats and no rows: see write_store."""
    path = fresh_path(docs.sparkSession, "ids")
    write_store(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
