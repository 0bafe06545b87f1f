"""What the operators of this subpackage share: reading tables, the shared folder, typed Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where no spark.checkpoint.dir is set, a local session (as in tests) gets a
    temporary folder of this process; a cluster has no folder to fall back on.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if not named and current is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        current = context.getCheckpointDir()
    elif current is None:
        context.setCheckpointDir(named)
    return (named or current).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Writes df to a new table of the shared folder and reads it from there: lineage ends here.

    The given schema is used to read, so an empty result reads back as well.
    by: a column whose values get a folder each.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path, partitionBy=by)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def drop_stored(df: DataFrame) -> None:
    """Deletes a table of stored() that no later step reads."""
    drop_path(df.sparkSession, df.stored_at)


class Tables:
    """Tables of one run of an operator, deleted together once its result is written."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        self.made.append(stored(df, name, by=by))
        return self.made[-1]

    def drop(self) -> None:
        for table in self.made:
            drop_stored(table)
        self.made = []


def whole_text(text: str = "text", null: str | None = "") -> F.Column:
    """The text column as a string; null texts count as `null`."""
    column = F.col(text).cast("string")
    return column if null is None else F.coalesce(column, F.lit(null))


class Cache:
    """key -> value in two generations: when the young one is full it becomes the old one, and what is asked for again moves up.

    compute gives the values of a list of distinct keys, so that all that one text lacks is worked out together; entries bounds a worker's memory.
    """

    def __init__(self, compute, entries: int = 100_000):
        self.compute, self.most = compute, max(1, entries // 2)
        self.young, self.old = {}, {}

    def many(self, keys: list) -> list:
        """Values of the keys, in their order."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        missing = {key: None for key, value in zip(keys, found) if value is None}
        for key in missing:
            missing[key] = self.old.get(key)
        wanted = [key for key, value in missing.items() if value is None]
        if wanted:
            missing.update(zip(wanted, self.compute(wanted), strict=True))
        if len(self.young) + len(missing) > self.most:
            self.old, self.young = self.young, {}
        if len(missing) <= self.most:
            self.young.update(missing)
        return [missing[key] if value is None else value for key, value in zip(keys, found)]


#: Rows that a task takes at once; bounds what stands beside the texts of an Arrow batch.
ROWS = 2_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ROWS rows, without copies."""
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with one object per task: make() runs once, and what it returns turns a batch into columns."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in (part for whole in batches for part in slices(whole)):
            columns = step(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
        finish = getattr(step, "finish", None)
        if finish is not None and (columns := finish()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
        # a worker stays for later tasks, what it has no use for goes back
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, wanted)
