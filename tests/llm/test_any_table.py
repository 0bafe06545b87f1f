"""Every operator and stage on tables with nulls, repeats, clashing columns, no rows, and a text of many megabytes."""

import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from palimpsest.llm import id_store, inner_topk, mpeg_audio, ngram_join, packing, roundtrip, secret_scan, token_counts, toxicity  # noqa: E402

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
MODEL = toxicity.Ordinal({"bad": 9.0}, [4.0, 5.0])

OPERATORS = {
    "tokens": lambda d: token_counts.count_tokens(d, PIECE),
    "pack": lambda d: packing.pack(d, BYTE),
    "classes": lambda d: ngram_join.classes(d),
    "media": lambda d: mpeg_audio.read_texts(mpeg_audio.store_texts(d)),
    "ids": lambda d: id_store.round_trip(d, WORD),
    "scan": lambda d: secret_scan.span_digests(secret_scan.scan(d, secret_scan.fresh_path(d.sparkSession, "ledger"))),
    "bpe": lambda d: roundtrip.digests(d, BYTE),
    "severity": lambda d: toxicity.score(d, MODEL),
}
STAGES = {
    "keep_clean": lambda d: toxicity.keep_clean(d, MODEL),
    "one_of_each": ngram_join.one_of_each,
    "redact": secret_scan.redact,
}
NAMES = "row id blob kinds starts ends __kinds __blob __id removed n_lines kept_text component_id class node size group key text_ part ids data name chunks root media severity grade rejected band tile pair side sequence_id offset a.b".split()
TEXTS = [None, "", "some words that say nothing", "password = abcdef1", "some words that say nothing", "bad bad words", "x" * 300]


def table(spark, texts=TEXTS, extra=NAMES):
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    if rows:
        rows += [(None, "no id here", "en", "s", 10), (2, texts[2], "en", "s", 5)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return given.withColumns({c: F.lit(f"own {c}") for c in extra if c != "a.b"}).withColumn("a.b", F.lit("own a.b")) if extra else given


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    run = OPERATORS[name]
    plain = run(table(spark, extra=()))
    clashing = run(table(spark))
    assert clashing.columns == plain.columns
    same = [c for c in plain.columns if c not in ("sequence_id", "offset", "start", "length", "sequence_length", "ids_crc32")]
    rows = sorted(map(str, plain.select(*same).collect()))
    assert rows == sorted(map(str, clashing.select(*same).collect())) and len(rows) >= len(TEXTS) + 2
    assert run(table(spark, [])).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, name):
    given = table(spark)
    found = STAGES[name](given)
    assert found.columns == given.columns
    rows = found.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in NAMES)
    texts = [r.text for r in rows]
    assert texts.count("no id here") == 1 and texts.count(None) == 1 and texts.count("") == 1
    assert ("bad bad words" in texts) == (name != "keep_clean")
    assert ("[assign]" in texts) == (name == "redact")
    assert STAGES[name](table(spark, [])).count() == 0


def test_stage_functions_keep_the_columns(spark, tmp_path):
    """Stages of the pipeline on documents with a column of another name, and on none."""
    spark.createDataFrame([(5, 1), (2, 0), (4, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for texts in (TEXTS, []):
        docs = table(spark, texts, ("removed", "__kinds"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, str(tmp_path))
            assert kept.columns == docs.columns
            assert kept.count() <= docs.count()
    assert corpus_pipeline.pack_tokens(spark, table(spark, []), str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    return " ".join(rng.choice(words) for _ in range(3_200_000)) + " password: abcdef12"


@pytest.mark.parametrize("name", OPERATORS)
def test_text_of_twenty_megabytes(spark, name, long_text):
    assert len(long_text) > 20_000_000
    given = spark.createDataFrame([(1, "")], "doc_id long, text string").withColumn("text", F.lit(long_text))
    assert OPERATORS[name](given).count() >= 1


def test_a_ledger_with_repeated_rows(spark, tmp_path):
    """Two writers that scanned the same blob count as one."""
    docs = table(spark, extra=())
    ledger = f"{tmp_path}/ledger"
    first = secret_scan.span_digests(secret_scan.scan(docs, ledger)).collect()
    spark.read.parquet(ledger).write.mode("append").parquet(ledger)
    again = secret_scan.span_digests(secret_scan.scan(docs, ledger)).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))


def test_the_rule_version_follows_the_rules():
    assert len(secret_scan.RULE_VERSION) == 16 and secret_scan.RULE_VERSION != "1"


def test_added_kinds():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJlLXh5eg"
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n-----END RSA PRIVATE KEY-----"
    text = f"a {jwt} b {pem} Bearer abcdefghijklmnopqrstuv ghp_{'a1' * 18} ghp_short"
    found = {k: text[a:b] for k, a, b in secret_scan.find(text)}
    assert found["jwt"] == jwt and found["pem"] == pem and found["bearer"] == "Bearer abcdefghijklmnopqrstuv" and found["pat"] == "ghp_" + "a1" * 18
    assert not secret_scan.find("Bearer short ghp_short eyJa.b.c -----BEGIN CERTIFICATE-----")


@pytest.mark.parametrize("size", [1e10, 1e300])
def test_inner_products_beyond_a_long(spark, size):
    """Vectors whose scores may not fit a long fail with a message that names them; large ones that fit are exact."""
    rows = [(k, [float(k % 7), 1.0, size if k == 3 else 0.5]) for k in range(45)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="may not fit 64 bits: vec_id 3"):
        inner_topk.top_k(given, "vec_id % 20 = 0").collect()


def test_large_inner_products_are_exact(spark):
    rows = [(k, [float(k % 7), 1.0, 3e7 if k in (3, 20) else 0.5]) for k in range(45)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id): r.score for r in inner_topk.top_k(given, "vec_id % 20 = 0").collect()}
    assert found[20, 3] == (64 * 6) * (64 * 3) + 64 * 64 + int(64 * 3e7) ** 2


def test_a_missing_chunk(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("some words to choose from here".split()) for _ in range(900)) for _ in range(3)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "store")
    id_store.write_store(given, path, WORD)
    whole = {r.doc_id: r for r in id_store.read_digests(spark, path).collect()}
    assert all(r.verified for r in whole.values()) and id_store.id_bytes(spark, path) == 2
    chunks = id_store._parts(spark, path, "chunk").collect()
    lost = chunks[0].name
    kept = spark.createDataFrame([c for c in chunks if c.name != lost], chunks and id_store._parts(spark, path, "chunk").schema)
    other = str(tmp_path / "other")
    kept.unionByName(id_store._parts(spark, path, "recipe")).write.partitionBy("kind").parquet(f"{other}/parts")
    for name in ("recipes", "offsets", "format"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{other}/{name}")
    found = {r.doc_id: r.verified for r in id_store.read_digests(spark, other).collect()}
    holders = {r.doc_id for r in id_store.read_recipes(spark, path).collect() if lost in r.chunks}
    assert holders and {d for d, good in found.items() if not good} == holders
    assert {r.doc_id for r in id_store.read_ids(spark, other).collect()} == set(found) - holders
