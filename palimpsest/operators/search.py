"""Exact vector search, pre-filtered, for a batch of queries.

Queries come as rows (query_id, query_vector). A batch of checked size goes to all
tasks, so the candidates are scanned once where they lie; a larger one is dealt, with
the candidates, over a grid of blocks of bounded size. Either way blocks are
scored as matrices, and a task hands on no more than a query's k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.operators import blocks as B

from palimpsest.functions import vectors as V

#: Queries, and bytes of their vectors, that are broadcast at most; beyond either they are dealt over a grid.
BROADCAST_QUERIES, BROADCAST_BYTES = 4096, 32 << 20
#: Blocks of candidates in that grid, at least, and candidates of a block.
CANDIDATE_BLOCKS, BLOCK_ROWS = 32, 65_536
#: Queries and candidates of a block, about, where all pairs of two blocks are handed on, and most partitions of such blocks.
PAIR_QUERIES, PAIR_ROWS, QUERY_PARTS, ROW_PARTS = 512, 2_048, 64, 256


def scored(queries: DataFrame, candidates: DataFrame, vector: str = "embedding", metric: str | None = None) -> DataFrame:
    """query_id, columns of the candidates but the vector, score of each candidate for each query, for results that are all pairs: use knn for the best.

    The score is null where a vector is null, not finite or of another length. Queries of
    checked size go to all tasks; of more, and of the candidates, blocks of bounded size
    are made, and partitions of blocks meet each other: each row is exchanged once,
    none is copied. The result grows with both tables, what a task holds does not.
    """
    V.higher_is_better(metric)
    queries = queries.select("query_id", "query_vector")
    order, others = candidates.columns, [f for f in candidates.schema if f.name != vector]
    schema = T.StructType([queries.schema["query_id"], *others, T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def pairs_of(given: pa.Table | pa.RecordBatch, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sound = given.column("query_id"), {}
        for k, values in enumerate(given.column("query_vector").to_pylist()):
            query, scores = np.array(values or [], dtype=np.float64), np.full(batch.num_rows, np.nan)
            if len(query) and np.isfinite(query).all():
                if len(query) not in sound:
                    sound[len(query)] = B.matrix(batch.column(vector), len(query))
                places, rows = sound[len(query)]
                scores[places] = B.exact(query[None], rows, metric or "cosine")
            columns = [pa.repeat(ids[k], batch.num_rows), *[batch.column(f.name) for f in others], pa.array(scores, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    if _small(queries):
        table = queries.toArrow()
        return candidates.mapInArrow(lambda batches: (out for batch in batches for out in pairs_of(table, batch)), schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = lambda column, k: pa.RecordBatch.from_struct_array(column[k].values)
        for batch in batches:
            for k in range(batch.num_rows):
                yield from pairs_of(rows_of(batch.column("queries"), k), rows_of(batch.column("rows"), k).select(order))

    spread, dealt = _blocks(candidates, "rows", PAIR_ROWS, ROW_PARTS), _blocks(queries, "queries", PAIR_QUERIES, QUERY_PARTS)
    return spread.hint("shuffle_replicate_nl").crossJoin(dealt).mapInArrow(met, schema)


def _blocks(df: DataFrame, name: str, rows: int, most: int) -> DataFrame:
    """The rows in lists (column `name`) of about so many, in at most so many partitions."""
    n = max(1, -(-df.count() // rows))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    dealt = df.select(F.pmod(F.xxhash64(F.col(f"`{df.columns[0]}`")), F.lit(n)).alias("block"), row.alias("row"))
    return dealt.repartition(min(n, most), "block").groupBy("block").agg(F.collect_list("row").alias(name)).select(name)


def _dealt(df: DataFrame, own: str, other: str, n: int, m: int) -> DataFrame:
    """The rows, each in one of n blocks (column own) and once for each of m others."""
    block = F.pmod(F.xxhash64(df.columns[0]), F.lit(max(n, 1))).cast("int")
    return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(m, 1) - 1))))


def ranked(hits: DataFrame, k: int, metric: str | None = None, tie: str = "uid", by: list[str] | None = None) -> DataFrame:
    """The k best hits per group (the query), numbered from 1; ties by `tie`."""
    order = W.partitionBy(*(by or ["query_id"])).orderBy(V.best_first(metric), tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, candidates: DataFrame, k: int, metric: str | None = None, threshold: float | None = None, where: Column | None = None, vector: str = "embedding", tie: str = "uid", per: list[str] | None = None) -> DataFrame:
    """query_id, columns of the candidates but the vector, score, rank: the k best candidates of each query (and group `per`) that pass filter and threshold.

    k <= 0 gives none. Ties go by `tie`. Candidates whose vector is null, not finite or of another length are no hits.
    """
    given = candidates if where is None else candidates.where(where)
    if k <= 0:
        given = given.limit(0)
    return ranked(best_of_blocks(queries, given, max(k, 1), metric, threshold, vector, tie, per), max(k, 1), metric, tie, ["query_id", *(per or [])])


def _small(queries: DataFrame) -> bool:
    """Whether the queries may go to every task."""
    size = queries.limit(BROADCAST_QUERIES + 1).agg(F.count("*").alias("n"), F.sum(F.size("query_vector").cast("long") * 8).alias("bytes")).first()
    return size.n <= BROADCAST_QUERIES and (size.bytes or 0) <= BROADCAST_BYTES


def best_of_blocks(queries: DataFrame, candidates: DataFrame, k: int, metric: str | None, threshold: float | None, vector: str, tie: str, per: list[str] | None = None) -> DataFrame:
    """query_id, columns of the candidates but the vector, score: of each block of candidates what can be among a query's k best (of a group)."""
    V.higher_is_better(metric)
    queries = queries.select("query_id", "query_vector")
    fields = [queries.schema["query_id"], *[f for f in candidates.schema if f.name != vector], T.StructField("score", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    arrow, order = to_arrow_schema(schema), [f.name for f in candidates.schema]

    def against(blocks: dict) -> dict:
        return {length: B.Best(vectors, k, metric, threshold) for length, (_, vectors) in blocks.items()}

    def found_in(blocks: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = against(blocks)
        for batch in batches:
            if per is None:
                yield from B.hits_of(blocks, best, batch, vector, tie, arrow)
            else:
                # the best of a group are kept within a batch only, so groups may be many
                for rows in batch.select(per).to_pandas().groupby(per, dropna=False).indices.values() if batch.num_rows else []:
                    yield from B.hits_of(blocks, against(blocks), batch.take(pa.array(rows)), vector, tie, arrow)

    if _small(queries):
        # its size is checked: it goes to the tasks with the function
        blocks = B.query_blocks(queries.toArrow())
        return candidates.mapInArrow(lambda batches: found_in(blocks, batches), schema)
    query_blocks = -(-queries.count() // BROADCAST_QUERIES)
    candidate_blocks = max(CANDIDATE_BLOCKS, -(-candidates.count() // BLOCK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    dealt = queries.withColumn("__q", block("query_id", query_blocks)).withColumn("__c", every(candidate_blocks))
    spread = candidates.withColumn("__c", block(tie, candidate_blocks)).withColumn("__q", every(query_blocks))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.select(order).combine_chunks().to_batches()
        return pa.Table.from_batches(found_in(B.query_blocks(left), iter(rows)), schema=arrow)

    return dealt.groupBy("__q", "__c").cogroup(spread.groupBy("__q", "__c")).applyInArrow(met, schema)


def best_per_seed(hits: DataFrame, seed: str, metric: str | None = None, digits: int | None = None) -> DataFrame:
    """query_id, seed, its best score, and seed_rank by score, then seed. digits: scores that are equal when rounded so are ties, and are given so."""
    score = F.col("score") if digits is None else F.round("score", digits)
    best = F.max(score) if V.higher_is_better(metric) else F.min(score)
    found = hits.groupBy("query_id", seed).agg(best.alias("score"))
    return found.withColumn("seed_rank", F.row_number().over(W.partitionBy("query_id").orderBy(V.best_first(metric), seed)))
