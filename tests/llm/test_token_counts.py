"""The transducer against the sentencepiece library."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from palimpsest.llm import token_counts  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a" * 3000, " " * 2500, "the" * 4000, "x y" * 2000, "<s> </s><unk>", "▁a ▁", "é中\n\n\t😀́", "one two\n" * 900, "one two\n" * 900]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_library(library):
    rng = random.Random(4)
    letters = "abcdeXYZ  \n\t'.,!?09é中文   réſKΣς<|>İ\x1c\x85\r_-▁😀"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(8000))]  # no place to cut surely
    assert token_counts.transducer(MODEL).counts(texts) == [len(x) for x in library.encode(texts)]


def test_wrong_guesses_are_mended(library, monkeypatch):
    monkeypatch.setattr(token_counts, "LOOK_BACK", (1,))
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(3000)) for _ in range(5)]
    assert token_counts.transducer(MODEL).counts(texts) == [len(x) for x in library.encode(texts)]


def test_table_made_anew(library, monkeypatch):
    machine = token_counts.Transducer(MODEL)
    monkeypatch.setattr(token_counts, "TRANSITIONS", 50)
    for text in ("some words here", "and other words there"):
        assert machine.counts([text]) == [len(library.encode(text))]


def test_query(spark, documents, library):
    rows = token_counts.count_tokens(documents(ODD), MODEL, limit=1000).orderBy("doc_id").collect()
    for r, text in zip(rows, ODD, strict=True):
        n = len(library.encode(text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 1000)
    assert token_counts.count_tokens(documents([]), MODEL).count() == 0


def test_sf(spark, small, library):
    given = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in given.collect()}
    for r in token_counts.count_tokens(given, MODEL).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id]))


def test_scan_takes_few_rounds(library, monkeypatch):
    """Maps that lack entries are extended for all chunks at once: far fewer passes than chunks, though every first entry is poor."""
    monkeypatch.setattr(token_counts, "LOOK_BACK", (1,))
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    machine = token_counts.Transducer(MODEL)
    rng = random.Random(8)
    text = "".join(rng.choice("etaoinshr") for _ in range(16 * 400))
    passes = []
    run = machine.run
    monkeypatch.setattr(machine, "run", lambda *a: passes.append(len(a[1])) or run(*a))
    assert machine.counts([text]) == [len(library.encode(text))]
    assert len(passes) < 12 and sum(passes) < 400 * 6


def test_text_of_twenty_megabytes(library):
    text = ("some words of a very long text, 12 " * 64 + "x" * 700) * 7000
    assert len(text) > 20_000_000
    machine = token_counts.transducer(MODEL)
    part = text[:294_000]
    assert machine.counts([part, ""]) == [len(library.encode(part)), 0]
    assert machine.counts([text])[0] > 5_000_000
