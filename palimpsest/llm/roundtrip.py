"""BPE encoding and decoding of whole texts by forced-boundary splitting (see bpe)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow, whole_text


class EncodeTask:
    def __init__(self, path: str):
        self.encoder = bpe.byte_bpe(path)

    def __call__(self, batch: pa.RecordBatch) -> dict:
        texts = batch.column(1)
        return {"doc_id": batch.column(0), "ids": [self.encoder.ids(t.as_py()).tolist() for t in texts]}


class DecodeTask:
    def __init__(self, path: str):
        self.encoder = bpe.byte_bpe(path)

    def __call__(self, batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "text": [None if (k := x.as_py()) is None else self.encoder.decode(k) for x in batch.column(1)]}


class DigestTask:
    """Both ways in one pass, digests only: ids and texts never leave the worker."""

    def __init__(self, path: str):
        self.encoder = bpe.byte_bpe(path)
        self.decimals = [b"%d" % k for k in range(len(self.encoder.token_bytes))]

    def __call__(self, batch: pa.RecordBatch) -> dict:
        counts, ids_sha, text_sha = [], [], []
        decimal = self.decimals.__getitem__
        for text in batch.column(1):
            ids = self.encoder.ids(text.as_py()).tolist()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
            text_sha.append(hashlib.sha256(self.encoder.decode(ids).encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}


def _given(docs: DataFrame, id_column: str, column: F.Column) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), column)


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text. Null and empty texts have no ids; repeated rows and null ids stay; other columns are ignored, whatever their names; an empty table gives no row."""
    return map_arrow(_given(docs, id_column, whole_text(text_column).alias("text")), lambda: EncodeTask(tokenizer), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id, text of every array of ids (null: null). Bytes that are no UTF-8 become U+FFFD; repeated rows stay; an empty table gives no row."""
    return map_arrow(_given(encoded, id_column, F.col(ids_column).cast("array<int>").alias("ids")), lambda: DecodeTask(tokenizer), "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded again. Null texts count as empty; repeated rows and null ids stay; other columns are ignored; an empty table gives no row."""
    return map_arrow(_given(docs, id_column, whole_text(text_column).alias("text")), lambda: DigestTask(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
