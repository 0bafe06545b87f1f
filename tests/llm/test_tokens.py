"""Packing, id store and round trip against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from palimpsest.llm import bpe, id_store, packing, roundtrip  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a", "a  ", "x" * 5000, "a<|endoftext|>b", "<|startoftext|> Hi", "don't I'LL 'S", "é中文   x　y ß\n\n\tz", "Σς Ⅷ K ſ", "a\x1cb\x85c", "one two " * 3000, "one two " * 3000]


def library(path):
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


@pytest.mark.parametrize(("make", "path"), [(bpe.ByteBpe, BYTE), (bpe.WordBpe, WORD)])
def test_encoders_equal_library(make, path):
    rng = random.Random(7)
    letters = "abcXYZ  \n\t'.,!?09é中文   's'réſKΣς<|>İ\x1c\x85\r_-"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    own, lib = make(path), library(path)
    for text, wanted in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(text).tolist() == wanted.ids, text


def test_every_token_encodes_to_itself():
    own = bpe.ByteBpe(BYTE)
    assert all(own.merger.core._encode_single_piece(t) == [k] for t, k in own.merger.ranks.items())


def test_round_trip(spark, documents):
    rows = roundtrip.digests(documents(ODD), BYTE).orderBy("doc_id").collect()
    lib = library(BYTE)
    for row, text in zip(rows, ODD, strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_tables(spark, documents):
    encoded = roundtrip.encode(documents(ODD), BYTE)
    assert [r.text for r in roundtrip.decode(encoded, BYTE).orderBy("doc_id").collect()] == [t or "" for t in ODD]
    broken = spark.createDataFrame([(1, [128 + 60]), (2, None)], "doc_id long, ids array<int>")
    assert [r.text for r in roundtrip.decode(broken, BYTE).orderBy("doc_id").collect()] == [library(BYTE).decode([188], skip_special_tokens=False), None]


def check_pieces(rows, texts):
    lib = library(BYTE)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(texts):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_packing(spark, documents, small):
    check_pieces(packing.pack(documents(ODD), BYTE, open_windows=2).collect(), ODD)
    given = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in given.collect()]
    check_pieces(packing.pack(given.withColumn("start", F.lit(1)), BYTE).collect(), texts)


def test_packing_places_best_fit():
    done = []
    packer = packing.Packer(10, 2, done.append)
    for k, n in enumerate((6, 7, 3, 4, 2)):
        packer.add(k, np.zeros(n, dtype="<u4"))
    assert [[(p[0], len(p[2])) for p in w] for w in done] == [[(1, 7), (2, 3)], [(0, 6), (3, 4)]]
    assert [p[0] for p in packer.leftovers()] == [4]


def test_empty_tables(spark, documents):
    none = documents([])
    assert packing.pack(none, BYTE).count() == 0
    assert roundtrip.digests(none, BYTE).count() == 0
    assert id_store.round_trip(none, WORD).count() == 0


def test_id_store(spark, documents, tmp_path):
    lib = library(WORD)
    texts = [*ODD, " ".join(f"w{k}" for k in range(9000)), "z " + " ".join(f"w{k}" for k in range(9000))]
    given = documents(texts).repartition(3)
    path = f"file://{tmp_path}/store"
    id_store.write_store(given, path, WORD)
    start = 0
    ids = {r.doc_id: r.ids for r in id_store.read_ids(spark, path).collect()}
    for row, text in zip(id_store.read_digests(spark, path).orderBy("doc_id").collect(), texts, strict=True):
        wanted = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        assert ids[row.doc_id] == wanted
        assert (row.start, row.n_tokens, row.verified) == (start, len(wanted), True)
        assert row.ids_crc32 == zlib.crc32(np.array(wanted, dtype="<u4").tobytes())
        start += len(wanted)
    stored = spark.read.parquet(f"{path}/parts").where("kind = 'chunk'")
    assert stored.count() == stored.select("name").distinct().count()
    assert stored.agg(F.sum("n_ids")).first()[0] < 0.75 * start


def test_repeated_rows(spark, documents):
    given = documents(["a b", "a b"], ids=[5, 5])
    rows = id_store.round_trip(given, WORD).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(5, 0, 3), (5, 3, 3)]
    assert sum(r.length for r in packing.pack(given, BYTE).collect()) == 6


def test_crc_combine():
    rng = random.Random(3)
    combine = id_store.Combine()
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 300)), rng.randbytes(rng.randint(0, 300))
        assert combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
