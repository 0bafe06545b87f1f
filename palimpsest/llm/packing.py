"""Bounded-space online packing of token ids into sequences of one window.

Each partition keeps a fixed number of open windows. What a document has beyond
full windows is placed best-fit: into the window that it leaves fullest. When
none fits and all windows are open, the fullest is filled up with the head of
the document and emitted. What is open at a partition's end is joined into full
windows and one remainder; remainders of a fixed number of partitions meet in
one small second step, where the last one is cut into powers of two, which need
no padding. Memory per task: the open windows and one document.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow, stored, whole_text

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
#: Sequence ids: the partition in the high bits, a counter in the low ones; merged remainders have ids of their own.
ID_BITS, MERGED = 32, 1 << 60


class Window:
    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def add(self, document, start: int, ids: np.ndarray, total: int) -> None:
        self.pieces.append((document, start, ids, total))
        self.used += len(ids)


class Packer:
    """Open windows of one partition; emit(pieces) is called with each window that is done."""

    def __init__(self, size: int, open_windows: int, emit):
        self.size, self.most, self.emit = size, open_windows, emit
        self.free: list[tuple[int, int]] = []  # (free space, key) of the open windows, ascending
        self.open: dict[int, Window] = {}
        self.keys = 0

    def add(self, document, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while total - at >= self.size:
            self.emit([(document, at, ids[at : at + self.size], total)])
            at += self.size
        while at < total:
            rest = total - at
            best = bisect_left(self.free, (rest, -1))
            if best < len(self.free):
                space, key = self.free.pop(best)
            elif len(self.open) < self.most:
                self.keys += 1
                space, key = self.size, self.keys
                self.open[key] = Window()
            else:
                space, key = self.free.pop(0)
            taken = min(space, rest)
            self.open[key].add(document, at, ids[at : at + taken], total)
            at += taken
            if taken == space:
                self.emit(self.open.pop(key).pieces)
            else:
                insort(self.free, (space - taken, key))

    def leftovers(self) -> list[tuple]:
        """Pieces of the windows that are still open, fullest window first."""
        found = [p for w in sorted(self.open.values(), key=lambda w: -w.used) for p in w.pieces]
        self.open, self.free = {}, []
        return found


def joined(pieces: list[tuple], size: int, emit) -> list[tuple]:
    """Emits full windows made of the pieces in turn, cutting at window ends; returns the pieces of the remainder."""
    current = Window()
    for document, start, ids, total in pieces:
        while len(ids):
            taken = min(size - current.used, len(ids))
            current.add(document, start, ids[:taken], total)
            start, ids = start + taken, ids[taken:]
            if current.used == size:
                emit(current.pieces)
                current = Window()
    return current.pieces


def powers(pieces: list[tuple], emit) -> None:
    """Emits the pieces as windows whose lengths are powers of two, largest first: no padding."""
    left = sum(len(p[2]) for p in pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        done: list[list] = []
        rest = joined(pieces, size, done.append)
        emit(done[0])
        pieces = [p for w in done[1:] for p in w] + rest
        left -= size


class Rows:
    """Columns of emitted pieces."""

    def __init__(self, first_id: int):
        self.next_id, self.rows = first_id, []

    def emit(self, pieces: list[tuple]) -> None:
        offset, length = 0, sum(len(p[2]) for p in pieces)
        for document, start, ids, total in pieces:
            self.rows.append((document, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset, length, None))
            offset += len(ids)
        self.next_id += 1

    def columns(self) -> dict | None:
        rows, self.rows = self.rows, []
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids")
        return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else None


class PackTask:
    def __init__(self, path: str, size: int, open_windows: int, end_id: int):
        self.encoder, self.size = bpe.byte_bpe(path), size
        self.end = np.array([end_id], dtype="<u4")
        self.rows = Rows(TaskContext.get().partitionId() << ID_BITS)
        self.packer = Packer(size, open_windows, self.rows.emit)

    def __call__(self, batch: pa.RecordBatch) -> dict | None:
        for document, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.concatenate([self.encoder.ids(text.as_py()).astype("<u4"), self.end])
            self.packer.add(document, ids)
        return self.rows.columns()

    def finish(self) -> dict | None:
        rest = joined(self.packer.leftovers(), self.size, self.rows.emit)
        for document, start, ids, total in rest:
            self.rows.rows.append((document, start, len(ids), None, total, None, None, None, ids.astype("<u4").tobytes()))
        return self.rows.columns()


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, open_windows: int = 32, end_id: int = 0, merge_partitions: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs the documents' ids (each followed by end_id) into sequences of at most `size` ids.

    Returns PIECES: one row per piece of a document. Null and empty texts are
    documents of the one id end_id; a null id is carried as null; repeated rows
    are packed once each; an empty table gives no row; other columns are ignored.
    Every sequence is full or a power of two long, so padding is zero. Ids of
    sequences depend on the partitions, not on the time of running.
    """
    size_power = size & (size - 1) == 0
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    rows = map_arrow(given, lambda: PackTask(tokenizer, size, open_windows, end_id), PIECES + ", ids binary").withColumn("part", F.spark_partition_id())
    kept = stored(rows, "packing")

    def merge(group: pa.Table) -> pa.Table:
        found = group.sort_by([("part", "ascending")]).to_pydict()
        out = Rows(MERGED + ((found["part"][0] // merge_partitions) << ID_BITS))
        pieces = [(d, s, np.frombuffer(i, dtype="<u4"), t) for d, s, i, t in zip(found["doc_id"], found["start"], found["ids"], found["doc_tokens"])]
        rest = joined(pieces, size, out.emit)
        powers(rest, out.emit) if size_power else out.emit(rest)
        columns = out.columns()
        return pa.table({k: pa.array(columns[k], pa.int64()) for k in columns if k != "ids"})

    remainders = kept.where(F.col("ids").isNotNull())
    merged = remainders.groupBy((F.col("part") / merge_partitions).cast("int").alias("group")).applyInArrow(lambda table: merge(table), PIECES)
    return kept.where(F.col("ids").isNull()).drop("ids", "part").unionByName(merged)
