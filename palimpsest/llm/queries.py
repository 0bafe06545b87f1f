"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fill_in_middle, id_store, inner_topk, interval_join, line_dedup, mpeg_audio, ngram_join, packing, roundtrip, secret_scan, token_counts, toxicity
from .common import fresh_path, table
from .sql import ORACLE_SQL


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the library of files is only needed where a query runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_inner_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), words=3, at_least=90)


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.read_texts(mpeg_audio.store_texts(table(spark, sf_dir, "documents")))


def op6_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_store.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.scan(table(spark, sf_dir, "documents"), fresh_path(spark, "ledger")))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.restore(fill_in_middle.transform(table(spark, sf_dir, "documents"))))


def op12_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_join.sales_and_sessions(*[table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clicks")])


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_packing, op3_inner_topk, op4_ngram_join, op5_mpeg_audio, op6_id_store, op7_secret_scan, op8_bpe_round_trip, op9_toxicity, op10_line_dedup, op11_fill_in_middle, op12_interval_join, op13_exact_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that can be stated so; the others are compared with libraries and brute force in tests/llm."""
    return dict(ORACLE_SQL)
