"""Exact top-k by integer inner product: norm-sorted, SVD-rotated, pruned by Cauchy-Schwarz.

Vectors become integer vectors. All are rotated by the right singular vectors
of the whole table (from its d x d Gram matrix, so the driver sees d * d
numbers), which puts most of the length into the first coordinates. Candidates
are cut into blocks by descending norm, at the quantiles of all norms, so that
the number of blocks follows the rows and not the partitions; queries into
blocks as well, and each pair of blocks is one task. A task walks tiles of candidates by descending
length: it stops for a query when length times length cannot reach its k-th
score; else the partial product over the first coordinates plus the product of
the residual lengths bounds each score, and what can still count is scored
exactly in integers. The k best per query and block then meet per query.

A query's k-th score from the block of the longest candidates is a bound that
is known before the other blocks run: pairs of blocks that it rules out are
never made. What is exchanged is blocks, never single pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, map_arrow, stored

QUERY_BLOCK, CANDIDATE_BLOCK, TILE, LEADING = 1024, 16384, 2048, 16
#: Bytes of a block's vectors, at which blocks of many dimensions have fewer rows.
BLOCK_BYTES = 32 << 20
#: Squared length that integer vectors stay under, so that every score fits a long.
LONGEST = 1 << 63
#: The blocks of longest vectors (one for each dimension) are broadcast up to so many bytes, else dealt out by slots of query blocks.
BROADCAST_BYTES = 64 << 20
#: Query blocks that share a slot, and so a copy of the candidate blocks' headers.
SLOT = 256
MATCH = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of each component; rows with null ids, null vectors, or null or non-finite components go.

    A vector whose integer components have squares of a sum of 2^63 or more fails
    with a message: its inner products would not be sure to fit a long.
    """
    vector = F.col(vector_column).cast("array<double>")
    given = df.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("x"))
    sound = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = given.where(sound).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("w"), F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("x"))
    squares = F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)
    # inner products are bounded by the lengths (Cauchy-Schwarz)
    fits = F.when(squares < float(LONGEST), F.col("w")).otherwise(F.raise_error(F.concat(F.lit("inner products of this vector may not fit 64 bits: vec_id "), F.col("vec_id").cast("string"))))
    return whole.select("vec_id", fits.cast("array<long>").alias("v"))


class GramTask:
    """Gram matrix sums per dimension of a partition."""

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}

    def __call__(self, batch: pa.RecordBatch) -> None:
        for d, rows, _ in _matrices(batch.column(0), None):
            self.sums[d] = self.sums.get(d, 0) + rows.T.astype(np.float64) @ rows

    def finish(self) -> dict | None:
        return {"d": list(self.sums), "gram": [g.ravel().tolist() for g in self.sums.values()]} if self.sums else None


def _matrices(column, ids):
    """(dimension, int64 matrix, ids) for each dimension of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    # of a part of a batch, its own values only
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = offsets[:-1] - offsets[0]
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, flat[starts[at][:, None] + np.arange(d)], None if ids is None else ids[at]


BLOCKS = "d int, ids binary, data binary, norm double"


def _packed(table: pa.Table) -> pa.Table:
    """One row of a block's rows (d, vec_id, v): ids, vectors, and the greatest norm."""
    v = table.column("v").combine_chunks()
    data = v.values.to_numpy(zero_copy_only=False).astype(np.int64)
    d = table.column("d")[0].as_py()
    norms = (data.reshape(len(v), d).astype(np.float64) ** 2).sum(axis=1)
    row = ([d], [table.column("vec_id").to_numpy().astype(np.int64).tobytes()], [data.tobytes()], [float(np.sqrt(norms.max(initial=0)))])
    return pa.table([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.float64()))], names=["d", "ids", "data", "norm"])


def blocked(vectors: DataFrame, rows: int, by_norm: bool, name: str, tables: Tables | None = None) -> DataFrame:
    """Rows (vec_id, v) in blocks (BLOCKS, block) of about `rows` rows of one dimension each: by descending norm, or by hash.

    The edges between blocks of norms are quantiles of the whole table, one number
    for each block; where more rows share a norm than a block holds they are dealt
    over several by a hash of the id. tables: gets what is stored.
    """
    tables = tables or Tables()
    sized = vectors.withColumn("d", F.size("v")).withColumn("n", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    most = lambda d: max(1, min(rows, BLOCK_BYTES // (8 * max(1, d))))
    counts = {r.d: r.n for r in sized.groupBy("d").agg(F.count("*").alias("n")).collect()}
    edges: dict[int, list[float]] = {}
    for d, n in counts.items() if by_norm else ():
        if (many := -(-n // most(d))) > 1:
            edges[d] = sorted(set(sized.where(F.col("d") == d).agg(F.percentile_approx("n", [k / many for k in range(1, many)], 10_000).alias("q")).first().q))

    class Place:
        def __call__(self, batch: pa.RecordBatch) -> dict:
            d, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            band = np.zeros(len(d), dtype=np.int64)
            for k in np.unique(d).tolist():
                at = d == k
                band[at] = np.searchsorted(np.array(edges.get(k, [])), n[at])
            return {"vec_id": batch.column(0), "v": batch.column(1), "d": d, "band": band}

    placed = tables.stored(map_arrow(sized.select("vec_id", "v", "d", "n"), Place, "vec_id long, v array<long>, d int, band long"), f"{name}-bands")
    # a row for each block: as many as the rows divided by a block's
    limits = F.create_map(*[F.lit(x) for d in counts for x in (d, most(d))]) if counts else F.lit(None)
    parts = placed.groupBy("d", "band").agg(F.ceil(F.count("*") / F.max(limits[F.col("d")])).cast("int").alias("parts")) if counts else placed.select("d", "band", F.lit(1).alias("parts"))
    dealt = placed.join(F.broadcast(parts), ["d", "band"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    whole = dealt.select("d", "band", "part", "vec_id", "v").groupBy("d", "band", "part").applyInArrow(lambda table: _packed(table), BLOCKS)
    return tables.stored(whole.withColumn("block", F.monotonically_increasing_id()), name)


def by_slots(queries: DataFrame, candidates: DataFrame, slots: int) -> DataFrame:
    """queries joined with candidates of their dimension (d), keyed by d and one of `slots` slots of query blocks.

    Most tables have vectors of one dimension, so d alone would be one key. Every
    slot has a copy of the candidates' rows; query rows are not copied.
    """
    dealt = queries.withColumn("slot", F.pmod(F.xxhash64("q_block"), F.lit(slots)))
    copies = candidates.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return dealt.join(copies, ["d", "slot"]).drop("slot")


def block_topk(q_ids, queries, c_ids, candidates, rotation, k: int, floor_scores: np.ndarray | None = None):
    """(query index, candidate index, score) of each query's k best candidates, ties to smaller ids.

    floor_scores: scores below which a candidate of a query cannot count.
    """
    n, d = queries.shape
    c_length = np.sqrt((candidates.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-c_length, kind="stable")
    candidates, c_ids, c_length = candidates[order], c_ids[order], c_length[order]
    lead = min(LEADING, d)
    q_turned, c_turned = queries @ rotation, candidates @ rotation
    q_length = np.sqrt((q_turned**2).sum(axis=1))
    q_rest = np.sqrt(np.maximum((q_turned[:, lead:] ** 2).sum(axis=1), 0))
    c_rest = np.sqrt(np.maximum((c_turned[:, lead:] ** 2).sum(axis=1), 0))
    exact = np.float64 if d * float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) < 2**52 else object
    q_exact, c_exact = queries.astype(exact), candidates.astype(exact)
    bar = np.full(n, -np.inf) if floor_scores is None else floor_scores.astype(np.float64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in range(n)]
    slack = 1e-9 * (q_length * c_length.max(initial=0) + 1)
    alive = np.arange(n)
    for at in range(0, len(candidates), TILE):
        tile = slice(at, at + TILE)
        alive = alive[q_length[alive] * c_length[at] + slack[alive] >= bar[alive]]
        if not len(alive):
            break
        bound = q_turned[alive, :lead] @ c_turned[tile, :lead].T + q_rest[alive, None] * c_rest[None, tile]
        open_pair = bound + slack[alive, None] >= bar[alive, None]
        open_pair &= q_ids[alive, None] != c_ids[None, tile]
        if open_pair.mean() > 0.05:
            scores = q_exact[alive] @ c_exact[tile].T
        else:
            scores = np.zeros(open_pair.shape, dtype=exact)
            qs, cs = np.nonzero(open_pair)
            for s in range(0, len(qs), 1 << 18):
                a, b = qs[s : s + (1 << 18)], cs[s : s + (1 << 18)]
                scores[a, b] = (q_exact[alive[a]] * c_exact[at + b]).sum(axis=1)
        open_pair &= scores >= bar[alive, None]
        for row, q in enumerate(alive.tolist()):
            cs = np.flatnonzero(open_pair[row])
            if not len(cs):
                continue
            new = np.array(scores[row, cs], dtype=np.int64)
            if len(cs) > 4 * k:  # only what reaches the k-th of the new ones, ties included
                keep = new >= np.partition(new, len(new) - k)[len(new) - k]
                cs, new = cs[keep], new[keep]
            scored, where = np.concatenate([best[q][0], new]), np.concatenate([best[q][1], at + cs])
            top = np.lexsort((c_ids[where], -scored))[:k]
            best[q] = (scored[top], where[top])
            if len(top) == k:
                bar[q] = max(bar[q], float(scored[top[-1]]))
    rows = [len(b[0]) for b in best]
    found = np.concatenate([b[1] for b in best]) if rows else np.empty(0, dtype=np.int64)
    return np.repeat(np.arange(n), rows), order[found], np.concatenate([b[0] for b in best]) if rows else found


class SearchTask:
    """A row is a pair of blocks: d, query ids, query vectors, bars (null: none), candidate ids, candidate vectors."""

    def __init__(self, k: int, rotations: dict[int, np.ndarray]):  # vectors without components have no rotation
        self.k, self.rotations = k, rotations

    def __call__(self, batch: pa.RecordBatch) -> dict | None:
        out = []
        for d, q_ids, q_data, bars, c_ids, c_data in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            qi, ci = np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(c_ids, dtype=np.int64)
            q, c = np.frombuffer(q_data, dtype=np.int64).reshape(len(qi), d), np.frombuffer(c_data, dtype=np.int64).reshape(len(ci), d)
            bar = None if bars is None else np.array([-np.inf if b is None else float(b) for b in bars])
            a, b, scores = block_topk(qi, q, ci, c, self.rotations.get(d, np.zeros((d, d))), self.k, bar)
            out.append((qi[a], ci[b], scores))
        if not out:
            return None
        return {name: np.concatenate([o[i] for o in out]).astype(np.int64) for i, name in enumerate(("query_id", "vec_id", "score"))}


def ranked(matches: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, query_condition: str, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query row with every other row, exactly.

    query_condition is SQL over vec_id and picks the query rows. Components are
    floor(scale * x). Rows whose id or vector is null, or that hold a null or
    non-finite component, take no part. A row's identity is its id: rows of the
    query's id are its own and no candidates; other repeated ids each count as
    rows. Vectors are only compared with vectors of their dimension. Ties go to
    the smaller id. An empty table gives no row; other columns are ignored.
    """
    given, tables = Tables(), Tables()
    whole = given.stored(quantised(vectors, scale, id_column, vector_column), "vectors")
    grams = map_arrow(whole.select("v"), GramTask, "d int, gram array<double>")
    sums = grams.select("d", F.posexplode("gram").alias("at", "x")).groupBy("d", "at").agg(F.sum("x").alias("x")).groupBy("d").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("gram"))
    rotations = {r.d: np.linalg.eigh(np.array([x.x for x in r.gram]).reshape(r.d, r.d))[1][:, ::-1] if r.d else np.zeros((0, 0)) for r in sums.collect()}
    c_blocks = blocked(whole, candidate_block, True, "candidates", tables)
    q_blocks = blocked(whole.where(query_condition), query_block, False, "queries", tables)
    given.drop()
    # the block of each dimension with the longest vectors gives every query a first k-th score
    first = c_blocks.groupBy("d").agg(F.max_by("block", F.struct("norm", -F.col("block"))).alias("block"))
    longest = c_blocks.join(F.broadcast(first), ["d", "block"], "left_semi")
    names = lambda df, p: df.select("d", *[F.col(c).alias(f"{p}_{c}") for c in ("ids", "data", "norm", "block")])
    none = F.lit(None).cast("array<double>")
    slots = max(1, -(-q_blocks.count() // SLOT))
    spread, lead = names(q_blocks, "q").repartition("q_block"), names(longest, "c")
    # the queries stay where they are and meet one block each
    size = longest.agg(F.coalesce(F.sum(F.octet_length("data") + F.octet_length("ids")), F.lit(0))).first()[0]
    start = spread.join(F.broadcast(lead), "d") if size <= BROADCAST_BYTES else by_slots(spread, lead, slots).repartition("q_block")
    seed = tables.stored(map_arrow(start.select("d", "q_ids", "q_data", none, "c_ids", "c_data"), lambda: SearchTask(k, rotations), MATCH), "first")
    bars = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bar"))

    class Unpack:
        def __call__(self, batch: pa.RecordBatch) -> dict:
            ids = [np.frombuffer(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
            data = [np.frombuffer(x, dtype=np.int64).reshape(len(i), d).astype(np.float64) for d, i, x in zip(batch.column(0).to_pylist(), ids, batch.column(2).to_pylist())]
            blocks = batch.column(3).to_pylist()
            return {"q_block": [b for b, i in zip(blocks, ids) for _ in range(len(i))], "at": [k for i in ids for k in range(len(i))], "query_id": [x for i in ids for x in i.tolist()], "length": [x for m in data for x in np.sqrt((m**2).sum(axis=1)).tolist()]}

    members = map_arrow(q_blocks.select("d", "ids", "data", "block"), Unpack, "q_block long, at int, query_id long, length double")
    # a pair of blocks can matter if some query's length times the block's longest reaches its bar
    needs = members.join(bars, "query_id", "left").groupBy("q_block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "bar"))), lambda x: x["bar"]).alias("bars"),
        # every candidate scores 0 with a query of length 0, so no block is ruled out for it
        F.min(F.coalesce(F.when(F.col("length") > 0, (F.col("bar") - 1) / F.col("length")), F.lit(float("-inf")))).alias("least"),
    )
    others = c_blocks.join(F.broadcast(first), ["d", "block"], "left_anti")
    headers = names(q_blocks, "q").select("d", "q_block").join(needs, "q_block").select("d", "q_block", "least")
    pairs = by_slots(headers, names(others, "c").select("d", "c_block", "c_norm"), slots).where(F.col("c_norm") >= F.col("least")).select("q_block", "c_block")
    work = pairs.join(names(q_blocks, "q").join(needs, "q_block").select("d", "q_ids", "q_data", "bars", "q_block"), "q_block").join(names(others, "c").drop("d"), "c_block").repartition("q_block", "c_block")
    rest = map_arrow(work.select("d", "q_ids", "q_data", "bars", "c_ids", "c_data"), lambda: SearchTask(k, rotations), MATCH)
    found = stored(ranked(seed.unionByName(rest), k), "top")
    tables.drop()
    return found
