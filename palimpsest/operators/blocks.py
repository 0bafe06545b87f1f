"""Scores of blocks: queries against rows of an Arrow batch as matrix products, the best k of each query kept.

Products only choose; the scores of what is chosen are worked out row by row, so
that equal vectors have equal scores wherever they lie. Vectors that are null, hold
a null or a number that is not finite, or have another length than the query, give
no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that stand in memory at once.
CELLS = 1 << 22
#: Share of a score's scale by which a product may be off.
SLACK = 1e-9


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the list column's sound vectors of a length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    of_length = pc.fill_null(pc.equal(pc.list_value_length(column), length), False)
    places = np.flatnonzero(of_length.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.filter(of_length)).cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = flat.reshape(len(places), length)
    sound = np.isfinite(found).all(axis=1)
    return places[sound], found[sound]


def by_length(column: pa.Array) -> list[int]:
    return [n for n in pc.unique(pc.list_value_length(column)).to_pylist() if n]


def exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows of q against the rows of c beside them."""
    if metric == "l1":
        return np.abs(q - c).sum(axis=1)
    if metric == "l2":
        return np.sqrt(((q - c) ** 2).sum(axis=1))
    dots = (q * c).sum(axis=1)
    if metric == "dot":
        return dots
    lengths = np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1))
    return np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)


def exact_of(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, at: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the pairs (q, at), worked out in slices of bounded memory."""
    step = max(1, CELLS // 4 // max(1, queries.shape[1]))
    parts = [exact(queries[q[n : n + step]], rows[at[n : n + step]], metric) for n in range(0, len(q), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def best_of(found: pd.DataFrame, k: int, better: bool) -> pd.DataFrame:
    """Of rows (q, score, tie) the k best of each q, with their place n."""
    found = found.sort_values(["q", "score", "tie"], ascending=[True, not better, True], kind="stable")
    found["n"] = found.groupby("q").cumcount()
    return found[found.n < k]


def near(q: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Closeness of all q to all c, more is better, and by how much it may be off."""
    if metric == "l1":
        return -np.stack([np.abs(c - x).sum(axis=1) for x in q]), SLACK * (1 + float(np.abs(q).sum(axis=1).max() + np.abs(c).sum(axis=1).max()))
    if metric == "cosine":
        unit = lambda x: np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
        return unit(q) @ unit(c).T, SLACK
    dots = q @ c.T
    if metric == "dot":
        return dots, SLACK * (1 + float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(c, axis=1).max()))
    qq, cc = (q * q).sum(axis=1)[:, None], (c * c).sum(axis=1)
    return 2 * dots - qq - cc, SLACK * (1 + float(qq.max() + cc.max()))


def closeness(scores: np.ndarray, metric: str) -> np.ndarray:
    """What near() gives for a score."""
    return scores if metric in ("cosine", "dot") else -(scores**2) if metric == "l2" else -scores


class Best:
    """The k best rows of each query among the blocks seen so far; what add() gives back holds all that can still be among them."""

    def __init__(self, queries: np.ndarray, k: int, metric: str | None, threshold: float | None = None):
        self.queries, self.k, self.metric, self.threshold = queries, k, metric or "cosine", threshold
        self.better = self.metric in ("cosine", "dot")
        self.kept = np.full((len(queries), k), -np.inf)

    def add(self, rows: np.ndarray, ties: np.ndarray) -> pd.DataFrame:
        """q, at, score of rows of a block (with what ties are broken by), at most k for a query."""
        step, kept = max(1, CELLS // max(1, len(self.queries))), []
        for at in range(0, len(rows), step):
            kept.append(self._part(rows[at : at + step], ties[at : at + step], at))
            # what later parts have displaced goes, so that no more than twice the result is held
            if len(kept) > 1 and sum(map(len, kept)) > len(self.queries) * self.k:
                kept = [best_of(pd.concat(kept, ignore_index=True), self.k, self.better)]
        found = best_of(pd.concat(kept, ignore_index=True), self.k, self.better) if kept else pd.DataFrame({"q": [], "at": [], "score": []})
        return found[["q", "at", "score"]]

    def _part(self, rows: np.ndarray, ties: np.ndarray, start: int) -> pd.DataFrame:
        close, slack = near(self.queries, rows, self.metric)
        least = self.kept[:, -1]
        if len(rows) > self.k:
            least = np.maximum(least, np.partition(close, -self.k, axis=1)[:, -self.k])
        q, at = np.nonzero(close >= (least - slack)[:, None])
        scores = exact_of(self.queries, rows, q, at, self.metric)
        if self.threshold is not None:
            fit = scores >= self.threshold if self.better else scores <= self.threshold
            q, at, scores = q[fit], at[fit], scores[fit]
        found = best_of(pd.DataFrame({"q": q, "at": at, "score": scores, "tie": ties[at]}), self.k, self.better)
        fresh = np.full_like(self.kept, -np.inf)
        fresh[found.q.to_numpy(), found.n.to_numpy()] = closeness(found.score.to_numpy(), self.metric)
        self.kept = -np.sort(-np.hstack([self.kept, fresh]), axis=1)[:, : self.k]
        return pd.DataFrame({"q": found.q, "at": found["at"] + start, "score": found.score, "tie": found.tie})


def tie_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def hits_of(queries: dict[int, tuple[pa.Array, np.ndarray]], best: dict[int, Best], batch: pa.RecordBatch, vector: str, tie: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, without the vector, that are among the best of a query so far: query_id, the row's columns, score."""
    others = [name for name in batch.schema.names if name != vector]
    for length, (ids, _) in queries.items():
        places, rows = matrix(batch.column(vector), length)
        if not len(places):
            continue
        found = best[length].add(rows, tie_array(batch.column(tie))[places])
        if len(found):
            taken = pa.array(places[found["at"].to_numpy(dtype=np.int64)])
            columns = [ids.take(pa.array(found.q.to_numpy(dtype=np.int64))), *[batch.column(n).take(taken) for n in others], pa.array(found.score.to_numpy(dtype=np.float64))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def query_blocks(table: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Sound queries of a table (query_id, query_vector) by the length of their vectors."""
    table = table.combine_chunks()
    ids, vectors = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in (table.column("query_id"), table.column("query_vector")))
    out = {}
    for length in by_length(vectors):
        places, found = matrix(vectors, length)
        if len(places):
            out[length] = ids.take(pa.array(places)), found
    return out
