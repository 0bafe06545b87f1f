"""Exact deduplication against a persistent index of digests.

The index is a Parquet table in a folder, bucketed and sorted by the SHA-256 of the
normalised text. A batch is summed up by digest on the map side (its best row and
its number of rows), shuffled to the buckets once, and meets the index in a
sort-merge anti-join that reads the index without a shuffle. Digests the index lacks
are appended as new, those it has as further copies. A digest's entries lie in
one bucket, so that the state of the index is a sum without a shuffle.

Which row of a group stays can change with later batches, as the longest text
stays; resolve() says who stays by the index as it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, fresh_path, stored, whole_text

#: A digest that holds over one in so many rows is joined by broadcast: there are fewer than so many.
HOT = 10_000
ENTRY = "digest binary, best struct<shorter:long,unnamed:boolean,doc_id:long,batch:long,row:long>, copies long, batch long, fresh boolean"
WHITE = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, WHITE, "")


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest (of the normalised text), chars (of the whole text), row: one row per row of docs; row is unique once this is stored."""
    text = whole_text(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """The index in one folder. The number of buckets is fixed when it is made; a folder that holds an index is opened as it is."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/format")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            self.buckets = spark.read.parquet(f"{self.path}/format").first().buckets
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/format")
        self.name = f"digests_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'")

    def entries(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, signed: DataFrame, batch: int) -> None:
        """Appends what the rows of stored signatures() with this batch number bring.

        First the digests that earlier batches lack, then further copies of those that
        they have; what a stopped run has appended already is not appended again.
        """
        best = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "batch", "row")
        summed = signed.where(F.col("batch") == batch).groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("copies"))
        # stored, or the joins would be made below the aggregate, of all rows of a digest
        tables = Tables()
        ready = tables.stored(summed, "summed").repartition(self.buckets, "digest")
        for fresh, how in ((True, "left_anti"), (False, "left_semi")):
            if self.entries().where((F.col("batch") == batch) & (F.col("fresh") == fresh)).isEmpty():
                known = self.entries().where(F.col("batch") < batch).select("digest").hint("merge")
                # rows lie as the buckets do, so each bucket gets one more sorted file
                ready.join(known, "digest", how).select("digest", "best", "copies", F.lit(batch).cast("long").alias("batch"), F.lit(fresh).alias("fresh")).write.insertInto(self.name)
        tables.drop()

    def state(self) -> DataFrame:
        """digest, best, size of every digest."""
        return self.entries().groupBy("digest").agg(F.min("best").alias("best"), F.sum("copies").alias("size"))

    def resolve(self, signed: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of stored signatures() that have been added.

        Digests with over one in HOT of all rows are joined by broadcast, the rest by merging.
        """
        state = self.state()
        total = self.entries().agg(F.sum("copies")).first()[0] or 0
        hot = state.where(F.col("size") * HOT > total)
        rest = signed.join(F.broadcast(hot.select(F.col("digest").alias("hot_digest"), F.col("best").alias("hot_best"), F.col("size").alias("hot_size"))), F.col("digest") == F.col("hot_digest"), "left")
        in_hot = rest.where("hot_digest IS NOT NULL").select("digest", "doc_id", "batch", "row", F.col("hot_best").alias("best"), F.col("hot_size").alias("size"))
        others = rest.where("hot_digest IS NULL").select("digest", "doc_id", "batch", "row").join(state.hint("merge"), "digest")
        stays = (F.col("row") == F.col("best.row")) & (F.col("batch") == F.col("best.batch"))
        return in_hot.unionByName(others).select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def forget(self) -> None:
        """Takes the table out of the catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup(docs: DataFrame, path: str | None = None, batches: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs, which come to the index at `path` (or a new one) in `batches` batches.

    Texts are equal if they are without ASCII white space; null texts count as
    empty, empty ones are equal to each other. The longest text (code points) stays, then
    the smallest id (null ids last); of rows that repeat an id and a text one stays.
    Other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, path or fresh_path(spark, "digest-index"))
    before = index.entries().agg(F.max("batch")).first()[0]
    first = 0 if before is None else before + 1
    signed = stored(signatures(docs, id_column, text_column), "signatures").withColumn("batch", F.pmod("row", F.lit(batches)) + first)
    for k in range(first, first + batches):
        index.add(signed, k)
    return index.resolve(signed)
