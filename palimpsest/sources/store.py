"""A store of named tables: a table is a base version, the parts appended to it and the keys deleted from it.

A change writes a whole new version, an append only its own rows, a delete only its
keys: readers leave out rows whose key was deleted after they came (merge on read),
until a compaction writes them off. A folder of Parquet files is seen when its
_SUCCESS marker is there, so a writer that dies leaves nothing behind that is read.
Versions, and the parts and deletes of a version, are numbered; a number is claimed
by making its file of claims, which the file system lets only one writer do.

A change of several tables is seen whole or not at all: its versions point to a
commit, which is one file made when all of them are written.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import tables as T
from palimpsest.session import stored


class Conflict(RuntimeError):
    """Another writer changed the table since it was read."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        """Names of what lies in a folder, if it is there."""
        fs, where = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _complete(self, folder: str, prefix: str) -> list[str]:
        """Paths of a folder's complete sub-folders of a prefix."""
        there = [f"{folder}/{name}" for name in self._names(folder) if name.startswith(prefix)]
        return [path for path in there if self._exists(f"{path}/_SUCCESS")]

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def _make(self, path: str) -> None:
        """Makes an empty file; fails if it is there."""
        fs, where = self._fs(path)
        fs.create(where, False).close()

    def versions(self, name: str) -> list[int]:
        """Numbers of the versions that are there, without those of a commit that was not made."""
        found = {int(p.rsplit("=", 1)[1]) for p in self._complete(f"{self.root}/{name}", "v=")}
        for pending in self._names(f"{self.root}/{name}/pending"):
            number, _, commit = pending.partition("-")
            if int(number) in found and not self._exists(f"{self.root}/_commits/{commit}"):
                found.discard(int(number))
        return sorted(found)

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def _claim(self, name: str, number: int | str) -> None:
        """Makes the claim of a version; a second writer of it fails."""
        try:
            self._make(f"{self.root}/{name}/claims/{number}")
        except Exception as error:  # the file is there
            raise Conflict(f"{name}: version {number} is being written") from error

    def _next(self, name: str, version: int) -> int:
        """A number for a part or a delete of a version, higher than all before."""
        taken = [int(c.partition(".")[2]) for c in self._names(f"{self.root}/{name}/claims") if c.startswith(f"{version}.")]
        number = max(taken, default=0)
        while True:
            number += 1
            try:
                self._claim(name, f"{version}.{number}")
                return number
            except Conflict:
                continue

    def _pieces(self, name: str, version: int) -> dict[int, str]:
        """Paths of the base (number 0) and the parts of a version by their numbers."""
        parts = self._complete(f"{self.root}/{name}/parts={version}", "p=")
        return {0: f"{self.root}/{name}/v={version}"} | {int(p.rsplit("=", 1)[1]): p for p in parts}

    def _deletes(self, name: str, version: int) -> dict[str, list[str]]:
        """Paths of the deletes of a version by the column that their keys are of."""
        folder = f"{self.root}/{name}/gone={version}"
        return {column.removeprefix("k="): found for column in self._names(folder) if (found := self._complete(f"{folder}/{column}", "d="))}

    def _left(self, rows: DataFrame, name: str, version: int, number: str) -> DataFrame:
        """Rows (with the number of their part) that no later delete names."""
        for column, paths in self._deletes(name, version).items():
            key = rows.schema[column].dataType.simpleString()
            gone = self.spark.read.schema(f"`{column}` {key}, {number} int").parquet(*paths).groupBy(F.col(column).alias("__key")).agg(F.max(number).alias("__gone"))
            rows = rows.join(gone, (F.col(column) == F.col("__key")) & (F.col(number) < F.col("__gone")), "left_anti")
        return rows

    def read(self, name: str, schema=None) -> DataFrame:
        """The table; an empty one of the schema where there is none yet."""
        found = self.versions(name)
        if not found:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        pieces = self._pieces(name, found[-1])
        kind = self.spark.read.parquet(pieces[0]).schema if schema is None else schema
        rows = self.spark.read.schema(kind).parquet(*pieces.values())
        if not self._deletes(name, found[-1]):
            return rows
        # the part that a row came with is in its file's path
        part = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", r"/p=(\d+)/[^/]*$", 1), F.lit("")).cast("int"), F.lit(0))
        return self._left(rows.withColumn("__number", part), name, found[-1], "__number").drop("__number")

    def write(self, name: str, df: DataFrame, after: int | None = None) -> DataFrame:
        """A new version; the one before stays for its readers, older ones go. after: the version that df was made from."""
        found = self.versions(name)
        last = (found[-1] if found else -1) if after is None else after
        self._claim(name, last + 1)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={last + 1}")
        self._tidy(name, [v for v in found if v < last])
        return self.read(name)

    def _tidy(self, name: str, versions: list[int]) -> None:
        for old in versions:
            for folder in ("v", "parts", "gone", "counts"):
                self._delete(f"{self.root}/{name}/{folder}={old}")

    def append(self, name: str, rows: DataFrame, schema=None) -> DataFrame:
        """The table with more rows; only these are written."""
        found = self.versions(name)
        if not found:
            return self.write(name, self.read(name, schema or rows.schema).unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/parts={found[-1]}/p={self._next(name, found[-1])}")
        return self.read(name)

    def delete(self, name: str, keys: DataFrame, column: str) -> DataFrame:
        """The table without the rows that have one of the keys (first column) in a column; only the keys are written. Rows appended later stay."""
        found = self.versions(name)
        if not found:
            raise KeyError(name)
        number = self._next(name, found[-1])
        kind = self.spark.read.parquet(f"{self.root}/{name}/v={found[-1]}").schema[column].dataType
        marks = keys.select(F.col(keys.columns[0]).cast(kind).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn("__number", F.lit(number))
        marks.write.mode("overwrite").parquet(f"{self.root}/{name}/gone={found[-1]}/k={column}/d={number}")
        return self.read(name)

    def change(self, name: str, step: Callable[[DataFrame], DataFrame], schema=None) -> DataFrame:
        """A new version made by a step from the last one; raises Conflict if another change came between. Appended parts and deletes come into it."""
        found = self.versions(name)
        return self.write(name, step(self.read(name, schema)), found[-1] if found else -1)

    def change_all(self, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        """New versions of several tables, made by their steps from what is there before, which are seen together.

        Where a step or a write fails, all tables stay as they were and may be changed again.
        """
        commit, before, claimed = uuid.uuid4().hex, {name: self.versions(name) for name in steps}, []
        if missing := [name for name, found in before.items() if not found]:
            raise KeyError(missing[0])
        try:
            made = {name: step(self.read(name)) for name, step in steps.items()}
            for name in steps:
                number = before[name][-1] + 1
                self._claim(name, number)
                claimed.append((name, number))
                self._make(f"{self.root}/{name}/pending/{number}-{commit}")
            for name, df in made.items():
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={before[name][-1] + 1}")
            self._make(f"{self.root}/_commits/{commit}")
        except BaseException:
            self._give_up(claimed, commit)
            raise
        for name, found in before.items():
            self._tidy(name, found[:-1])

    def _give_up(self, claimed: list[tuple[str, int]], commit: str) -> None:
        for name, number in claimed:
            self._delete(f"{self.root}/{name}/v={number}")
            self._delete(f"{self.root}/{name}/pending/{number}-{commit}")
            self._delete(f"{self.root}/{name}/claims/{number}")

    def recover(self, name: str) -> None:
        """Takes away what a change_all left that died before its commit. Not while one runs."""
        for pending in self._names(f"{self.root}/{name}/pending"):
            number, _, commit = pending.partition("-")
            if not self._exists(f"{self.root}/_commits/{commit}"):
                self._give_up([(name, int(number))], commit)

    def compact(self, name: str) -> DataFrame:
        """The table as one version, without parts and deletes."""
        return self.change(name, lambda df: df)

    def copy(self, name: str, other: TableStore) -> None:
        """The table as it is now into another store."""
        other.write(name, self.read(name))

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")


class KeptCounts:
    """Rows of a table by the values of a column, kept beside it: each part is counted once, when it is new.

    A delete by the same column takes whole counts away, as it takes away rows. Deletes
    by other columns, and new versions, make the counts of their version useless; it is
    counted anew from the rows.
    """

    def __init__(self, store: TableStore, name: str, column: str):
        self.store, self.name, self.column = store, name, column

    def _folder(self, version: int) -> str:
        return f"{self.store.root}/{self.name}/counts={version}/k={self.column}"

    def refresh(self) -> int | None:
        """Counts the parts that are not counted yet; the version that counts are kept for, None where they cannot be."""
        versions = self.store.versions(self.name)
        if not versions or set(self.store._deletes(self.name, versions[-1])) - {self.column}:
            return None
        counted = {int(p.rsplit("=", 1)[1]) for p in self.store._complete(self._folder(versions[-1]), "c=")}
        for number, path in self.store._pieces(self.name, versions[-1]).items():
            if number not in counted:
                counts = self.store.spark.read.parquet(path).groupBy(self.column).agg(F.count("*").alias("n")).withColumn("__number", F.lit(number))
                counts.write.mode("overwrite").parquet(f"{self._folder(versions[-1])}/c={number}")
        return versions[-1]

    def read(self) -> DataFrame:
        """column, n: rows of each value, without reading rows that have been counted."""
        version = self.refresh()
        if version is None:
            return self.store.read(self.name).groupBy(self.column).agg(F.count("*").alias("n"))
        counts = self.store.spark.read.parquet(*self.store._complete(self._folder(version), "c="))
        return self.store._left(counts, self.name, version, "__number").groupBy(self.column).agg(F.sum("n").alias("n"))

    def of(self, value) -> int:
        return self.read().where(F.col(self.column) == value).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class ConfigMismatch(ValueError):
    """An object is there with another configuration."""


#: Namespaces and names of collections and partitions.
NAME = re.compile(r"[a-z0-9_]{1,32}")
CONFIGS = "kind string, namespace string, name string, config string"


class Catalogue:
    """Collections and partitions with immutable configurations."""

    def __init__(self, store: TableStore, kind: str):
        self.store, self.kind = store, kind

    def config(self, namespace: str, name: str) -> str | None:
        rows = self.store.read("configs", CONFIGS).where((F.col("kind") == self.kind) & (F.col("namespace") == namespace) & (F.col("name") == name)).collect()
        return rows[0].config if rows else None

    def create(self, namespace: str, name: str, config: str) -> None:
        for part in (namespace, name):
            if not NAME.fullmatch(part):
                raise ValueError(f"{part!r} is no name of up to 32 lower-case letters, digits and underscores")
        if self.config(namespace, name) is not None:
            raise ConfigMismatch(f"{namespace}/{name} is there already")
        row = self.store.spark.createDataFrame([(self.kind, namespace, name, config)], CONFIGS)
        self.store.append("configs", row, CONFIGS)

    def open(self, namespace: str, name: str) -> str:
        if (found := self.config(namespace, name)) is None:
            raise KeyError(f"{namespace}/{name}")
        return found

    def open_or_create(self, namespace: str, name: str, config: str) -> str:
        """The configuration; one that differs from what is there raises."""
        found = self.config(namespace, name)
        if found is None:
            self.create(namespace, name, config)
        elif found != config:
            raise ConfigMismatch(f"{namespace}/{name} has another configuration")
        return config

    def delete(self, namespace: str, name: str, tables: dict[str, str] | None = None) -> None:
        """Deletes the object, and first its rows of other tables (table to the column that has its name); that it is not there is no error."""
        key = self.store.spark.range(1).select(F.lit(name).alias("name"))
        for table, column in (tables or {}).items():
            if self.store.exists(table):
                self.store.delete(table, key, column)
        gone = (F.col("kind") == self.kind) & (F.col("namespace") == namespace) & (F.col("name") == name)
        self.store.change("configs", lambda df: T.without_matches(df, gone), CONFIGS)


SESSIONS = "session_key string, created_at timestamp, configuration string, description string, metadata string, status string"


class Sessions:
    """Session rows: created active, deleted softly, listed by status and metadata."""

    def __init__(self, store: TableStore):
        self.store = store

    def rows(self) -> DataFrame:
        return self.store.read("sessions", SESSIONS)

    def create(self, key: str, configuration: str = "{}", description: str = "", metadata: str = "{}") -> None:
        if not self.rows().where(F.col("session_key") == key).isEmpty():
            raise ConfigMismatch(f"session {key} is there already")
        row = self.store.spark.range(1).select(F.lit(key).alias("session_key"), F.current_timestamp().alias("created_at"), F.lit(configuration).alias("configuration"), F.lit(description).alias("description"), F.lit(metadata).alias("metadata"), F.lit("active").alias("status"))
        self.store.append("sessions", row, SESSIONS)

    def set_status(self, key: str, status: str) -> None:
        self.store.change("sessions", lambda df: df.withColumn("status", F.when(F.col("session_key") == key, status).otherwise(F.col("status"))), SESSIONS)

    def find(self, status: str | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
        from palimpsest.functions.properties import contains

        found = self.rows()
        if status is not None:
            found = found.where(F.col("status") == status)
        return found.where(contains(F.col("metadata"), metadata)) if metadata else found

    def purge(self, tables: list[str]) -> None:
        """Removes the sessions marked deleted, and their rows from the given tables (column session_key); only keys are written."""
        gone = self.rows().where("status = 'deleted'").select("session_key")
        for name in tables:
            self.store.delete(name, gone, "session_key")
        self.store.delete("sessions", gone, "session_key")

    def drain(self, table: str, key: str, children: dict[str, str], batch: int = 1000, most: int | None = None) -> int:
        """Deletes the rows of sessions marked deleted, `batch` keys at a time, and rows of other tables (children: table to column) that have the keys; the batches made.

        Children go before their parents and sessions when none of their rows is left, so
        what a stopped run has not reached is found again by the next one: the rows that are
        left are the queue. most: batches to make at most.
        """
        made = 0
        gone = self.rows().where("status = 'deleted'").select("session_key")
        while most is None or made < most:
            keys = self.store.read(table).join(gone, "session_key", "left_semi").select(key).distinct().orderBy(key).limit(batch)
            if keys.isEmpty():
                self.store.delete("sessions", gone, "session_key")
                break
            # fixed before the first delete changes what they come from
            keys = stored(keys, "drain")
            for name, column in children.items():
                self.store.delete(name, keys, column)
            self.store.delete(table, keys, key)
            made += 1
        return made
