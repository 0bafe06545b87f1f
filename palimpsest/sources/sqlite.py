"""SQLite files as a Spark data source: ranges of a key are partitions, filters go into the source, rows come page by page.

A table lies in one file or in a folder of files that executors see at the same path.
read_table() takes a text of the filter language. What SQLite decides as Spark does
goes into the source as an option (equality, order of numbers, IN, null tests, and
AND, OR, NOT of those); the whole filter is applied to what comes out of it. Spark's
own hand-over of filters to Python sources is not used: it keeps the filters of one query
with the table, and a second query of the same DataFrame reads with them.
"""

from __future__ import annotations

import contextlib
import json
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.plans.filters import And, Comparison, Expr, In, IsNull, Not, Or, compile_filter, parse_filter, resolver

#: Rows of a page, and key ranges of a file, unless options say otherwise.
PAGE, PARTITIONS = 10_000, 8
TYPES = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}
VALUES = {T.LongType(): (int,), T.DoubleType(): (int, float), T.StringType(): (str,)}


def local(path: str) -> Path:
    """The path of a file URL or a plain path."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError("SQLite files lie where the file system of all machines has them")
    return Path(unquote(found.path))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def files(path: str) -> list[str]:
    where = local(path)
    return sorted(map(str, where.glob("*.db"))) if where.is_dir() else [str(where)]


def pushed(tree: Expr, kinds: dict[str, T.DataType]) -> tuple[str, list] | None:
    """SQL and values of what SQLite can decide of a filter: of an AND the sides that it can, of OR and NOT the whole or None."""
    if isinstance(tree, And):
        sides = [found for side in (tree.left, tree.right) if (found := pushed(side, kinds))]
        return _joined(" AND ", sides) if sides else None
    if isinstance(tree, Or):
        sides = [_whole(side, kinds) and pushed(side, kinds) for side in (tree.left, tree.right)]
        return _joined(" OR ", sides) if all(sides) else None
    if isinstance(tree, Not):
        found = _whole(tree.expr, kinds) and pushed(tree.expr, kinds)
        return (f"NOT ({found[0]})", found[1]) if found else None
    if not _whole(tree, kinds):
        return None
    if isinstance(tree, IsNull):
        return f"{quoted(tree.field)} IS NULL", []
    if isinstance(tree, In):
        return f"{quoted(tree.field)} IN ({', '.join('?' * len(tree.values))})", list(tree.values)
    return f"{quoted(tree.field)} {tree.op} ?", [tree.value]


def _joined(word: str, sides: list[tuple[str, list]]) -> tuple[str, list]:
    return word.join(f"({sql})" for sql, _ in sides), [v for _, values in sides for v in values]


def _whole(tree: Expr, kinds: dict[str, T.DataType]) -> bool:
    """Whether SQLite can decide all of a filter: known columns, values of their types, order of numbers only."""
    if isinstance(tree, (And, Or)):
        return _whole(tree.left, kinds) and _whole(tree.right, kinds)
    if isinstance(tree, Not):
        return _whole(tree.expr, kinds)
    kind = kinds.get(tree.field)
    if isinstance(tree, IsNull):
        return kind is not None
    fits = lambda v: type(v) in VALUES.get(kind, ())
    if isinstance(tree, In):
        return bool(tree.values) and all(map(fits, tree.values))
    return isinstance(tree, Comparison) and fits(tree.value) and (tree.op in ("=", "!=", "<>") or kind != T.StringType())


@dataclass
class KeyRange(InputPartition):
    """Rows of a file whose key lies between two values, both inclusive; None: rows without a key."""

    file: str
    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table, self.key = schema, options["path"], options["table"], options["key"]
        self.ranges, self.page = int(options.get("partitions", PARTITIONS)), int(options.get("page", PAGE))
        self.where = json.loads(options.get("where", "[]"))

    def _where(self) -> tuple[str, list]:
        return (f" AND ({self.where[0]})", self.where[1]) if self.where else ("", [])

    def partitions(self) -> list[KeyRange]:
        """Equal key ranges of each file's keys that pass the filters."""
        found, (more, values) = [], self._where()
        for file in files(self.path):
            with contextlib.closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as db:
                low, high, without = db.execute(f"SELECT min({quoted(self.key)}), max({quoted(self.key)}), sum({quoted(self.key)} IS NULL) FROM {quoted(self.table)} WHERE true{more}", values).fetchone()
            if without:
                found.append(KeyRange(file, None, None))
            if low is not None:
                step = -(-(high - low + 1) // self.ranges)
                found += [KeyRange(file, at, min(at + step - 1, high)) for at in range(low, high + 1, step)]
        return found or [KeyRange("", None, None)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        """Pages of a range in the order of the key: each begins after the last key of the one before."""
        if not partition.file:
            return
        schema = to_arrow_schema(self.schema)
        names, key = ", ".join(quoted(f.name) for f in self.schema), quoted(self.key)
        more, values = self._where()
        with contextlib.closing(sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True)) as db:
            if partition.low is None:
                pages = db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {key} IS NULL{more}", values)
                while rows := pages.fetchmany(self.page):
                    yield self._batch(rows, schema)
                return
            after = partition.low - 1
            while True:
                # rows that share a key stay together, so a page ends at a key
                last = db.execute(f"SELECT max(k) FROM (SELECT {key} AS k FROM {quoted(self.table)} WHERE {key} > ? AND {key} <= ?{more} ORDER BY {key} LIMIT ?)", [after, partition.high, *values, self.page]).fetchone()[0]
                if last is None:
                    return
                yield self._batch(db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {key} > ? AND {key} <= ?{more} ORDER BY {key}", [after, last, *values]).fetchall(), schema)
                after = last

    def _batch(self, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        """Columns of the table by their declared types; other types are read as texts."""
        with contextlib.closing(sqlite3.connect(f"file:{files(self.options['path'])[0]}?mode=ro", uri=True)) as db:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(name, TYPES.get(kind.upper(), T.StringType())) for _, name, kind, *_ in columns])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, key: str, where: str | None = None, **options) -> DataFrame:
    """A table of SQLite files, or its rows that pass a text of the filter language."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").options(path=path, table=table, key=key, **{k: str(v) for k, v in options.items()})
    if not where:
        return reader.load()
    tree, kinds = parse_filter(where), {f.name: f.dataType for f in SqliteSource({"path": path, "table": table}).schema()}
    rows = reader.option("where", json.dumps(pushed(tree, kinds) or [])).load()
    return rows.where(compile_filter(tree, resolver({c: c for c in kinds})))


def write_table(df: DataFrame, path: str, table: str, key: str) -> None:
    """df as a folder of SQLite files, one per partition, each with an index of the key; a task that is run again replaces its file."""
    where, names = local(path), df.columns
    where.mkdir(parents=True, exist_ok=True)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    made = ", ".join(f"{quoted(n)} {kinds.get(t, 'TEXT')}" for n, t in df.dtypes)
    texts = df.select(*[c if t in kinds or t == "string" else df[c].cast("string").alias(c) for c, t in df.dtypes])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        file, n = where / f"part-{number:05d}.tmp{attempt}", 0
        with contextlib.closing(sqlite3.connect(file)) as db:
            db.execute(f"CREATE TABLE {quoted(table)} ({made})")
            for frame in frames:
                rows = frame.astype(object).where(frame.notna(), None).values.tolist()
                db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})", rows)
                n += len(rows)
            db.execute(f"CREATE INDEX {quoted('by_' + key)} ON {quoted(table)} ({quoted(key)})")
            db.commit()
        os.replace(file, where / f"part-{number:05d}.db")
        yield pd.DataFrame({"n": [n]})

    texts.mapInPandas(run, "n long").agg({"n": "sum"}).collect()
