"""Vector collections and exact search."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import search as S
from palimpsest.operators import tables as T
from palimpsest.plans.filters import compile_filter, parse_filter, resolver

from .common import vector_queries, vectors

SCORES = {
    "cosine": "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])",
    "dot": "list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])",
    "l2": "list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])",
    "l1": "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE)))",
}


def _knn(metric: str, k: int = 5, threshold: float | None = None, text: str | None = None, per: list[str] | None = None):
    def run(spark, sf):
        condition = compile_filter(parse_filter(text), resolver({"label": "label"})) if text else None
        found = S.knn(vector_queries(spark, sf), vectors(spark, sf), k, metric, threshold, condition, per=per)
        return found.select("query_id", *(per or []), "rank", "uid", F.round("score", 6).alias("score"))

    return run


def _sql(metric: str, k: int = 5, condition: str = "true", per: str = "") -> str:
    order = f"{'s DESC' if metric in ('cosine', 'dot') else 's'}, uid"
    extra = f"{per}, " if per else ""
    return (
        f"WITH x AS (SELECT q.vec_id AS query_id, c.vec_id AS uid, c.label, {SCORES[metric]} AS s FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0), "
        f"y AS (SELECT *, row_number() OVER (PARTITION BY {extra}query_id ORDER BY {order}) AS rank FROM x WHERE {condition}) "
        f"SELECT query_id, {extra}CAST(rank AS INTEGER) AS rank, uid, round(s, 6) AS score FROM y WHERE rank <= {k}"
    )


def _best(spark, sf):
    """Labels stand for the segments that vectors were derived from."""
    hits = S.knn(vector_queries(spark, sf), vectors(spark, sf), 40)
    return S.best_per_seed(hits, "label", digits=6).select("query_id", "label", "seed_rank", "score")


def _ordered(spark, sf):
    return T.in_order_of(vectors(spark, sf), [7, 3, 100000, 3, 42], "uid").select("pos", "uid", "label")


def _upsert(spark, sf):
    old = vectors(spark, sf).select("uid", "label", F.lit(0).alias("version"))
    new = old.where("uid % 5 = 0").select("uid", (F.col("label") + 100).alias("label"), F.lit(1).alias("version"))
    more = old.where("uid < 3").select((F.col("uid") + 1000000).alias("uid"), "label", F.lit(1).alias("version"))
    return T.upsert(old, new.union(more), ["uid"], "version").select("uid", "label")


def _delete(spark, sf):
    df = vectors(spark, sf)
    return T.without_ids(df, df.where("label = 3").select("uid"), "uid").select("uid", "label")


QUERIES = {
    **{f"vec_topk_{m}": (_knn(m), _sql(m)) for m in SCORES},
    "vec_threshold": (_knn("cosine", 50, 0.2), _sql("cosine", 50, "s >= 0.2")),
    "vec_threshold_l2": (_knn("l2", 50, 1.3), _sql("l2", 50, "s <= 1.3")),
    "vec_filtered": (_knn("cosine", 5, None, "label IN (1, 2, 3)"), _sql("cosine", 5, "label IN (1, 2, 3)")),
    "vec_per_group": (_knn("cosine", 3, per=["label"]), _sql("cosine", 3, per="label")),
    "vec_best_per_seed": (_best, f"WITH h AS (SELECT query_id, e.label, score FROM ({_sql('cosine', 40)}) JOIN embeddings e ON e.vec_id = uid), b AS (SELECT query_id, label, max(score) AS score FROM h GROUP BY 1, 2) SELECT query_id, label, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INTEGER) AS seed_rank, score FROM b"),
    "vec_get_ordered": (_ordered, "SELECT CAST(p.pos AS INTEGER) AS pos, e.vec_id AS uid, e.label FROM (VALUES (0, 7), (1, 3), (2, 100000), (3, 3), (4, 42)) p(pos, id) JOIN embeddings e ON e.vec_id = p.id"),
    "vec_upsert": (_upsert, "SELECT vec_id AS uid, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id < 3"),
    "vec_delete": (_delete, "SELECT vec_id AS uid, label FROM embeddings WHERE label <> 3"),
}
