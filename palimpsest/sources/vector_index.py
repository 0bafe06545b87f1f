"""A persisted index of vectors for approximate search, with exact scores of what it finds.

Vectors lie in lists by their nearest centroid. Centroids are fitted on a bounded
sample: the SAMPLE rows of least hash of their id. What a search reads of the lists
are codes: the residual to the centroid in one byte a dimension with a scale per vector.
Lists are cut into parts of about PART rows, so that no list is one task. The
best of the codes are scored again by the vectors themselves.

How many lists a query looks into is measured when the index is made: the least
number that finds TARGET of the exact neighbours within the sample.

The index is a table store (see store): additions are appended parts, removals are
deletes that later additions do not see, and compact() writes both off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import vectors as V
from palimpsest.operators import blocks as B
from palimpsest.operators import search as S
from palimpsest.session import stored
from palimpsest.sources.store import TableStore

#: Rows that centroids and the number of lists to look into are fitted on, at most.
SAMPLE = 20_000
#: Lists, at most, and rounds of their fit.
LISTS, ROUNDS = 4_096, 12
#: Rows of a part of a list, about; queries that meet a part in one task, about.
PART, QUERIES = 65_536, 4_096
#: Share of the exact neighbours within the sample that the lists looked into must hold, and neighbours that count.
TARGET, NEIGHBOURS = 0.97, 10
#: Hits of the codes that are scored again, for each that is wanted.
REFINE = 4
CELL = "list int, part int, uid {uid}, code binary, scale float"
FORMAT = "metric string, dimensions int, probes int, centroids array<array<double>>"


def _unit(x: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1) - 2 * (x @ c.T)


def nearest(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of each row, nearest first, in slices of bounded memory."""
    step = max(1, B.CELLS // len(centroids))
    parts = [np.argsort(_squares(x[at : at + step], centroids), axis=1, kind="stable")[:, :n] for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, n), int)


def fit_centroids(x: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from rows drawn by a seed; a centroid that loses all rows stays where it is."""
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centroids)[:, 0]
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def fit_probes(x: np.ndarray, centroids: np.ndarray, metric: str, target: float) -> int:
    """The least number of lists that holds the target's share of the exact neighbours of the first rows among all rows of a sample."""
    queries = x[:200]
    best = B.Best(queries, min(NEIGHBOURS + 1, len(x)), metric)
    found = best.add(x, np.arange(len(x)))
    found = found[found.q != found["at"]]
    order, of = nearest(queries, centroids, len(centroids)), nearest(x, centroids)[:, 0]
    depth = np.argsort(order, axis=1)[found.q.to_numpy(dtype=int), of[found["at"].to_numpy(dtype=int)]]
    return int(np.quantile(depth, target, method="higher")) + 1 if len(depth) else len(centroids)


def _meetings(of: np.ndarray, wanted: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, queries) that meet: rows by their list (`of`), queries by the lists wanted, or all with all where none are named."""
    if not wanted:
        return
    if wanted[0] is None:
        yield np.arange(len(of)), np.arange(len(wanted))
        return
    sizes = [len(lists) for lists in wanted]
    asking, named = np.repeat(np.arange(len(wanted)), sizes), np.concatenate([np.asarray(lists, int) for lists in wanted])
    for one in np.intersect1d(of, named):
        yield np.flatnonzero(of == one), asking[named == one]


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        """Opens the index of a folder."""
        self.spark, self.store = spark, TableStore(spark, path)
        made = self.store.read("format").first()
        self.metric, self.dimensions, self.probes = made.metric, made.dimensions, made.probes
        self.centroids = np.array(made.centroids, dtype=np.float64).reshape(-1, made.dimensions)

    @classmethod
    def create(cls, vectors: DataFrame, path: str, metric: str = "cosine", lists: int | None = None, target: float = TARGET) -> VectorIndex:
        """An index of vectors (unique uid, embedding, and columns to filter by), made in a new folder.

        Rows whose vector is null, not finite or of another length than most of the sample are left out.
        """
        spark = vectors.sparkSession
        V.higher_is_better(metric)
        sample = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("embedding").toArrow().column("embedding")
        column = sample.combine_chunks() if sample.num_chunks else pa.array([], pa.list_(pa.float64()))
        kinds = {n: B.matrix(column, n)[1] for n in B.by_length(column)}
        if not any(map(len, kinds.values())):
            raise ValueError("an index needs a sound vector at least")
        x = max(kinds.values(), key=len)
        x = _unit(x) if metric == "cosine" else x
        lists = min(lists or max(1, round(vectors.count() ** 0.5)), LISTS, max(1, len(x) // 4))
        centroids = fit_centroids(x, lists)
        row = (metric, x.shape[1], fit_probes(x, centroids, metric, target), centroids.tolist())
        TableStore(spark, path).write("format", spark.createDataFrame([row], FORMAT).coalesce(1))
        index = cls(spark, path)
        index.add(vectors)
        return index

    def add(self, vectors: DataFrame) -> None:
        """Adds vectors, whose ids must not be in the index: remove them first."""
        kinds = self.rows().schema if self.store.exists("vectors") else vectors.schema
        vectors = vectors.select(*[F.col(f.name).cast(f.dataType) for f in kinds])
        uid = kinds["uid"].dataType.simpleString()
        placed = stored(self._coded(vectors, uid), "placed")
        # a list's parts are for the rows that come together
        sizes = placed.groupBy("list").agg((F.floor((F.count("*") - 1) / PART) + 1).cast("int").alias("parts"))
        cells = placed.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
        self.store.append("cells", cells.select("list", "part", "uid", "code", "scale").repartition("list", "part").sortWithinPartitions("list", "part"), CELL.format(uid=uid))
        self.store.append("vectors", vectors.join(placed.select("uid"), "uid", "left_semi").select(*vectors.columns))
        self.store.append("shape", sizes)

    def _coded(self, vectors: DataFrame, uid: str) -> DataFrame:
        """list, uid, code, scale of each sound vector."""
        centroids, cosine, length = self.centroids, self.metric == "cosine", self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, x = B.matrix(batch.column(1), length)
                if not len(places):
                    continue
                x = _unit(x) if cosine else x
                at = nearest(x, centroids)[:, 0]
                rest = x - centroids[at]
                scale = np.abs(rest).max(axis=1) / 127
                code = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
                columns = [pa.array(at.astype(np.int32)), batch.column(0).take(pa.array(places)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "uid", "code", "scale"])

        return vectors.select("uid", "embedding").mapInArrow(run, f"list int, uid {uid}, code binary, scale float")

    def remove(self, ids: DataFrame) -> None:
        """Removes ids (first column); ids that are not there do not matter."""
        keys = stored(ids.select(F.col(ids.columns[0]).alias("uid")).distinct(), "removed")
        for name in ("cells", "vectors"):
            self.store.delete(name, keys, "uid")

    def rows(self) -> DataFrame:
        """uid, embedding and the other columns of what the index holds."""
        return self.store.read("vectors")

    def get(self, ids: DataFrame) -> DataFrame:
        """uid, embedding of ids (first column) that are there."""
        return self.rows().join(ids.toDF("uid").distinct(), "uid", "left_semi").select("uid", "embedding")

    def compact(self) -> None:
        """Writes removals and additions off."""
        for name in ("cells", "vectors"):
            self.store.compact(name)
        self.store.change("shape", lambda df: df.groupBy("list").agg(F.max("parts").alias("parts")))

    def save(self, path: str) -> VectorIndex:
        """The index as it is now, in another folder."""
        other = TableStore(self.spark, path)
        for name in ("cells", "vectors", "shape", "format"):
            self.store.copy(name, other)
        return VectorIndex(self.spark, path)

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, query_vector, lists: the lists that each query looks into."""
        centroids, cosine, length = self.centroids, self.metric == "cosine", self.dimensions
        schema = T.StructType([queries.schema["query_id"], queries.schema["query_vector"], T.StructField("lists", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, x = B.matrix(batch.column(1), length)
                lists = nearest(_unit(x) if cosine else x, centroids, probes)
                taken = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], names=["query_id", "query_vector", "lists"])

        return queries.select("query_id", "query_vector").mapInArrow(run, schema)

    def shortlist(self, queries: DataFrame, k: int, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, uid of the k best by their codes in the lists looked into, of the allowed ids (first column) if given.

        Parts of lists are dealt into bundles. A query goes once to each bundle that it
        looks into, with the lists that it wants there, and gets k rows of it at most.
        """
        probes = min(probes or self.probes, len(self.centroids))
        cells = self.store.read("cells")
        if probes < len(self.centroids):
            probed = stored(self._probed(queries, probes), "probed")
            lists = probed.select(F.explode("lists").alias("list")).distinct()
            if lists.limit(1001).count() <= 1000:
                # few lists: only their row groups are read
                cells = cells.where(F.col("list").isin([r.list for r in lists.collect()]))
        if allowed is not None:
            cells = cells.join(allowed.toDF("uid").distinct(), "uid", "left_semi")
        bundles = max(S.CANDIDATE_BLOCKS, -(-cells.count() // PART))
        blocks = max(1, -(-queries.count() // QUERIES))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        bundle = lambda *key: F.pmod(F.xxhash64(*key), F.lit(bundles)).cast("int").alias("bundle")
        given = queries.select("query_id", "query_vector")
        if probes < len(self.centroids):
            shape = self.store.read("shape").groupBy("list").agg(F.max("parts").alias("parts"))
            looked = probed.select("query_id", F.explode("lists").alias("list")).join(shape, "list").select("query_id", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            wanted = looked.groupBy("query_id", bundle("list", "part")).agg(F.collect_set("list").alias("lists"))
            asked = given.join(wanted, "query_id").select("query_id", "query_vector", "lists", "bundle", block)
            spread = cells.withColumn("bundle", bundle("list", "part"))
        else:
            # all lists: every query goes to every bundle, so rows are dealt evenly
            asked = given.select("query_id", "query_vector", F.lit(None).cast("array<int>").alias("lists"), F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), block)
            spread = cells.withColumn("bundle", bundle("uid"))
        spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        centroids, metric, length = self.centroids, self.metric, self.dimensions
        uid = cells.schema["uid"].dataType.simpleString()
        kind = queries.schema["query_id"].dataType.simpleString()

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"query_id": left.column("query_id").slice(0, 0), "uid": right.column("uid").slice(0, 0), "close": pa.array([], pa.float64())}
            if left.num_rows and right.num_rows:
                left, right = left.combine_chunks(), right.combine_chunks()
                places, q = B.matrix(left.column("query_vector"), length)
                codes, scale = np.frombuffer(b"".join(right.column("code").to_pylist()), np.int8).reshape(-1, length), right.column("scale").to_numpy()
                of, ties = right.column("list").to_numpy(), B.tie_array(right.column("uid").combine_chunks())
                wanted = left.column("lists").take(pa.array(places)).to_pylist()
                parts = []
                for rows, asking in _meetings(of, wanted):
                    x = centroids[of[rows]] + codes[rows] * scale[rows, None].astype(np.float64)
                    found = B.Best(q[asking], k, metric).add(x, ties[rows])
                    at = rows[found["at"].to_numpy(dtype=np.int64)]
                    parts.append(pd.DataFrame({"q": asking[found.q.to_numpy(dtype=np.int64)], "at": at, "score": B.closeness(found.score.to_numpy(dtype=np.float64), metric), "tie": ties[at]}))
                if parts:
                    found = B.best_of(pd.concat(parts, ignore_index=True), k, True)
                    out = {"query_id": left.column("query_id").take(pa.array(places[found.q.to_numpy(dtype=np.int64)])), "uid": right.column("uid").take(pa.array(found["at"].to_numpy(dtype=np.int64))), "close": pa.array(found.score.to_numpy(dtype=np.float64))}
            return pa.table(out)

        found = asked.groupBy("bundle", "block").cogroup(spread.groupBy("bundle", "block")).applyInArrow(met, f"query_id {kind}, uid {uid}, close double")
        return S.ranked(found.withColumnRenamed("close", "score"), k, "cosine").select("query_id", "uid")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None, allowed: DataFrame | None = None, refine: int = REFINE) -> DataFrame:
        """query_id, uid, the index's other columns but the vector, score (exact), rank: the k best of queries (query_id, query_vector).

        probes: lists to look into; all of them, with refine high enough, give the exact result. Queries without a sound vector of the index's length find nothing.
        """
        if k <= 0:
            raise ValueError("a search needs a positive number of hits")
        best = self.shortlist(queries, k * refine, probes, allowed)
        scored = best.join(self.rows(), "uid").join(queries.select("query_id", "query_vector"), "query_id").withColumn("score", V.similarity(F.col("query_vector"), F.col("embedding"), self.metric))
        others = [c for c in self.rows().columns if c not in ("uid", "embedding")]
        return S.ranked(scored.where(V.passes(self.metric, F.col("score"), threshold)), k, self.metric).select("query_id", "uid", *others, "score", "rank")


def filtered_search(index: VectorIndex, queries: DataFrame, where: Column | None, k: int | None = None, over_fetch: int = 4, least: float = 0.5, probes: int | None = None) -> DataFrame:
    """query_id, uid, score, rank, exact: approximate search and then the filter, exact search for queries that this leaves short.

    With a filter over_fetch times as many hits are asked for; a query of which fewer
    than `least` of the wanted ones pass is answered by the exact search over all
    rows that pass. k: 1,000 if not given.
    """
    k = 1000 if k is None else k
    if where is None:
        return index.search(queries, k, probes).select("query_id", "uid", "score", "rank", F.lit(False).alias("exact"))
    hits = stored(index.search(queries, k * over_fetch, probes).where(where).select("query_id", "uid", "score"), "filtered")
    enough = hits.groupBy("query_id").count().where(F.col("count") >= k * least).select("query_id")
    kept = S.ranked(hits.join(enough, "query_id", "left_semi"), k, index.metric).withColumn("exact", F.lit(False))
    short = stored(queries.join(enough, "query_id", "left_anti"), "short")
    exact = S.knn(short, index.rows(), k, index.metric, where=where).withColumn("exact", F.lit(True))
    return kept.unionByName(exact.select(*kept.columns))
