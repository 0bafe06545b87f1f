"""Golden cases of operators and functions."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ids, text, vectors
from palimpsest.operators import clusters, context, features, graph, memory, rerank, scoring, search, sets, tables
from palimpsest.sources import chats
from palimpsest.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_chunks(spark):
    lit = F.lit
    assert one(spark, text.chunks(lit("This is a sample text for chunking."), 10)) == ["This is a ", "sample tex", "t for chun", "king."]
    assert one(spark, text.chunks(lit(""), 5)) == [] == one(spark, text.balanced_chunks(lit(""), 5))
    assert one(spark, text.balanced_chunks(lit("AAAAABBBBBCCCCC"), 3)) == ["AAA", "AAB", "BBB", "BCC", "CCC"]
    with pytest.raises(ValueError, match="positive"):
        text.chunks(lit("x"), 0)


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.sentences(lit("One. Two!\nThree... --- 。四。One."))) == ["One.", "Two!", "Three...", "四。"]
    assert one(spark, text.json_quoted(lit('é "x"\n/'))) == json.dumps('é "x"\n/', ensure_ascii=False)
    assert one(spark, text.without_nul(lit("a\0b"))) == "ab"
    assert one(spark, text.word_budget(8000)) == 500 and one(spark, text.word_budget(8001)) == 500 and one(spark, text.word_budget(8016)) == 600
    assert one(spark, text.tail(lit("line one\nline two\nline three"), 4)) == "line three"
    assert one(spark, text.halves(lit("abcde"))) == ["ab", "cde"]
    assert one(spark, text.ids(F.array(lit(" b"), lit("a"), lit(""), lit("b ")))) == ["a", "b"]
    assert one(spark, F.unix_seconds(text.parsed_time(lit("1700000000")))) == one(spark, F.unix_seconds(text.parsed_time(lit("1700000000000")))) == 1700000000
    assert one(spark, text.parsed_time(lit("no time"))) is None
    at = F.to_timestamp(lit("2024-01-05 15:04:00"))
    assert one(spark, text.line(at, lit("ann"), lit("hi"))) == '[Friday, January 05, 2024 at 03:04 PM] ann: "hi"'
    assert one(spark, text.formatted(at)) == "" and one(spark, text.formatted(at, "long", "short")) == "January 5, 2024, 3:04 PM"
    assert one(spark, text.fact_in_text(lit("City: Paris is big"), lit("x\nwe say paris is  big here"))) is True
    assert one(spark, text.fact_in_text(lit("alpha beta gamma delta epsilon"), lit("alpha beta gamma other words too"))) is True
    assert one(spark, text.fact_in_text(lit("alpha beta gamma delta epsilon"), lit("alpha beta other words here too"))) is False
    assert text.last_object('x {"a": 1} y {"b": {"c": 2}} z') == '{"b": {"c": 2}}' and text.last_object("none") is None


def test_splitter():
    given = "First part. Second part!\n\nThird " + "x" * 40 + " end"
    pieces = text.split_text(given, 20)
    # white space at the ends of pieces goes
    assert "".join(pieces).replace(" ", "") == "".join(given.split()) and max(map(len, pieces)) <= 20
    assert pieces[:2] == ["First part.", "Second part!"]
    assert text.split_text("one],\ntwo? three. four", 12) == ["one],", "two?", "three. four"]
    assert text.split_text("") == [] and text.split_text("abc") == ["abc"]
    assert all(len(p) <= 30 for p in text.word_chunks("some words " * 20, 30)) and " ".join(text.word_chunks("some words " * 20, 30)).split() == ["some", "words"] * 20


def test_ids(spark):
    key = ids.partition_key(F.lit("Session/1"))
    assert len(one(spark, key)) == 32 and one(spark, ids.partition_key(F.lit("abc_1"))) == "abc_1"
    assert one(spark, ids.uuid5(F.lit("x"), uuid.NAMESPACE_DNS)) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x"))
    assert one(spark, ids.child_id(F.lit("c"), F.lit(1))) != one(spark, ids.child_id(F.lit("c"), F.lit(2)))


def test_metrics(spark):
    a, b, zero = (F.array(*map(F.lit, v)) for v in ([1.0, 2.0], [3.0, 4.0], [0.0, 0.0]))
    assert one(spark, vectors.dot(a, b)) == 11 and one(spark, vectors.l1(a, b)) == 4
    assert one(spark, vectors.l2(a, b)) == pytest.approx(8**0.5) and one(spark, vectors.cosine(a, zero)) == 0
    assert one(spark, vectors.mean(F.array(a, b))) == [2.0, 3.0]
    with pytest.raises(ValueError, match="unknown"):
        vectors.higher_is_better("other")


def test_search(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.8, 0.6], "x"), (3, [0.0, 1.0], "y"), (4, [1.0, 0.0], "y")], "uid long, embedding array<double>, label string")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, query_vector array<double>")
    hits = lambda **k: [(r.query_id, r.uid) for r in search.knn(queries, docs, **k).orderBy("query_id", "rank").collect()]
    assert hits(k=2) == [(7, 1), (7, 4), (8, 3), (8, 2)]
    assert hits(k=2, where=F.col("label") == "y") == [(7, 4), (7, 3), (8, 3), (8, 4)]
    assert hits(k=5, threshold=0.7) == [(7, 1), (7, 4), (7, 2), (8, 3)]
    assert hits(k=5, metric="l2", threshold=0.1) == [(7, 1), (7, 4), (8, 3)]
    assert hits(k=0) == []
    assert hits(k=1, per=["label"]) == [(7, 1), (7, 4), (8, 2), (8, 3)] or len(hits(k=1, per=["label"])) == 4


def test_large_query_batch(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    docs = spark.range(20).select(F.col("id").alias("uid"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    queries = docs.where("uid < 8").select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert search.knn(queries, docs, 1, "l2").where("query_id = uid").count() == 8


def test_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    assert [r.id for r in tables.page(df, [F.col("id")], 2, 1).collect()] == [3]
    with pytest.raises(ValueError, match="size"):
        tables.page(df, [F.col("id")], None, 1)
    assert {r.id for r in tables.without_matches(df, F.col("v") == "a").collect()} == {2, 3}
    assert [(r.pos, r.id) for r in tables.in_order_of(df, [3, 9, 1, 3], "id").collect()] == [(0, 3), (2, 1), (3, 3)]
    changes = spark.createDataFrame([(1, None), (3, "z")], "id long, v string")
    assert {(r.id, r.v) for r in tables.patch(df, changes, "id", ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "z")}
    assert tables.insert_missing(df, changes.withColumn("id", F.col("id") + 2), ["id"]).count() == 4
    mapping = spark.createDataFrame([("a", "b")], "o string, n string")
    assert tables.collisions(df, mapping, "v").count() == 1
    assert sorted(r.v or "" for r in tables.rewrite_keys(df, mapping, "v").collect()) == ["", "b", "b"]


def test_context(spark):
    assert context.split_expansion(10) == (3, 7) and context.split_expansion(50, 20) == (6, 13)
    rows = spark.range(10).select(F.lit("p").alias("part"), F.col("id").alias("uid"))
    seeds = spark.createDataFrame([(4,), (9,)], "seed long")
    found = context.neighbours(rows, seeds, ["part"], ["uid"], "uid", 1, 2, F.col("uid") != 5)
    assert {(r.seed, r.uid, r.distance) for r in found.collect()} == {(4, 3, -1), (4, 4, 0), (4, 6, 1), (4, 7, 2), (9, 8, -1), (9, 9, 0)}
    assert context.neighbours(rows, seeds, ["part"], ["uid"], "uid", 1, 1, F.col("uid") != 4).where("seed = 4").count() == 0
    scan = context.keyset(rows, ["uid"], [F.lit(7)], [False], include_equal=True, limit=2)
    assert [r.uid for r in scan.collect()] == [7, 6]
    assert context.keyset(rows, ["uid"], [None], [True], limit=3).count() == 3


def test_budget(spark):
    rows = [(1, k, k - 3) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "context_rank int, uid int, distance int").withColumn("q", F.lit(1))
    kept = lambda n: {r.uid for r in context.budget_union(df, n, ["q"], "uid").collect()}
    assert kept(10) == {1, 2, 3, 4, 5} and kept(3) == {3, 4, 5} and kept(4) == {2, 3, 4, 5}


def test_graph(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    edges = spark.createDataFrame([("e", "a", "b"), ("e", "c", "a"), ("e", "a", "b")], "relation string, source_uid string, target_uid string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    found = lambda d: {r.uid for r in graph.related(nodes, edges, seeds, d).collect()}
    assert (found("out"), found("in"), found("both")) == ({"b"}, {"c"}, {"b", "c"})
    more = graph.add_edges(edges, nodes, spark.createDataFrame([("e", "b", "c"), ("e", "b", "zz")], edges.schema))
    assert more.count() == 4
    left, kept = graph.detach(nodes, edges, spark.createDataFrame([("b",)], "uid string"))
    assert (left.count(), kept.count()) == (2, 1)


def test_pending_sets(spark):
    rows = [("a", "fake_a", True), ("a", "fake_b", False), ("b", "fake_c", True), ("c", "fake_d", False), ("c", "fake_a", False)]
    h = spark.createDataFrame(rows, "set_id string, history_id string, ingested boolean").withColumn("created_at", F.current_timestamp())
    found = lambda n: {r.set_id for r in features.pending_sets(h, n).collect()}
    assert (found(0), found(1), found(2)) == ({"a", "b", "c"}, {"a", "c"}, {"c"})
    assert {r.history_id for r in features.purgeable(h).collect()} == {"fake_c"}
    assert features.dirty_sets(h, 2, F.current_timestamp()).count() == 2
    assert features.dirty_sets(h, None, None).count() == 3


def test_commands(spark):
    log = spark.createDataFrame([(1, "add", "k", "1"), (2, "delete", "k", None), (3, "add", "k", "2"), (4, "add", "j", "3"), (5, "delete", "i", None)], "seq long, command string, feature string, value string")
    start = spark.createDataFrame([("k", "0"), ("i", "0"), ("h", "0")], "feature string, value string")
    assert {(r.feature, r.value) for r in features.apply_commands(start, log, ["feature"]).collect()} == {("k", "2"), ("j", "3"), ("h", "0")}


def test_profile_json(spark):
    df = spark.createDataFrame([("s", "t", "f", "old", 1), ("s", "t", "f", "new", 2), ("s", "u", "g", "x", 1)], "set_id string, tag string, feature string, value string, n int")
    assert features.profile_json(df, ["set_id"], ["n"]).first().profile == {"t": '{"f":"new"}', "u": '{"g":"x"}'}


def test_sets(spark):
    own = spark.createDataFrame([("s", "x")], "set_id string, name string")
    inherited = spark.createDataFrame([(1, "x"), (1, "y")], "type_id int, name string")
    links = spark.createDataFrame([("s", 1), ("r", 1)], "set_id string, type_id int")
    assert {tuple(r) for r in sets.resolve_categories(own, inherited, links).collect()} == {("s", "x", "own"), ("s", "y", "inherited"), ("r", "x", "inherited"), ("r", "y", "inherited")}
    assert {r.set_id for r in sets.sets_of_category(inherited, own, links, "x").collect()} == {"r"}


def test_short_term(spark):
    df = spark.createDataFrame([("s", k, "user1" if k == 1 else "user2", "abcdef") for k in range(3)], "session string, n int, producer_id string, content string")
    found = lambda **k: [r.n for r in memory.short_term(df, "session", ["n"], summary_chars=F.lit(11), **k).orderBy("position").collect()]
    assert found(most_chars=100) == [2, 1, 0] and found(most_chars=19) == [2] and found(limit=1) == [2]
    assert found(where=F.col("producer_id") == "user1") == [1] and found() == [2, 1, 0]


def test_rerankers(spark):
    given = spark.createDataFrame([(1, "What is the capital of France?", k, t) for k, t in enumerate(["Hello, world!", "Berlin is the capital of Germany.", "Paris is the capital of France."])], "query_id int, query string, pos int, text string")
    scores = [r.score for r in rerank.bm25(given).orderBy("pos").collect()]
    assert scores == sorted(scores) and scores[2] > scores[0]
    assert [r.score for r in rerank.identity(given).orderBy("pos").collect()] == [2.0, 1.0, 0.0]
    ranks = [(1, "a", k, f"s{k}", float(s)) for k, s in enumerate([1, 2, 4])] + [(1, "b", k, f"s{k}", float(s)) for k, s in enumerate([2, 1, 4])]
    fused = {r.text: r.score for r in rerank.reciprocal_ranks(spark.createDataFrame(ranks, "query_id int, ranker string, pos int, text string, score double")).collect()}
    assert fused["s0"] == fused["s1"] < fused["s2"]
    best = rerank.rerank(given, rerank.by_model(given, lambda q, t: float("Paris" in t), lambda t: text.chunks(t, 10))).where("rank = 1").first()
    assert best.pos == 2
    assert rerank.bm25(given.withColumn("text", F.lit(""))).agg(F.sum("score")).first()[0] == 0


def test_clusters():
    state = clusters.Clusters(0.8)
    assert state.assign("a", [1.0, 0.0], 0) == 0 and state.assign("b", [0.9, 0.1], 5) == 0
    assert state.counts == [2] and state.centroids[0].tolist() == pytest.approx([0.95, 0.05]) and state.last == [5]
    assert state.assign("c", [0.0, 1.0], 6) == 1 and state.assign("b", [0.0, 1.0], 7) == 0
    assert state.assign("z", [0.0, 0.0], 8) == 2
    assert clusters.Clusters(1.0).assign("x", [1.0, 0.0], 0) == 0
    exact = clusters.Clusters(1.0)
    assert [exact.assign(k, [1.0, 0.0], k) for k in (1, 2)] == [0, 0]
    with pytest.raises(ValueError, match="dimensions"):
        state.assign("d", [1.0], 9)
    late = clusters.Clusters(0.1, max_gap=10)
    assert [late.assign(k, [1.0, 0.0], 100.0 * k) for k in (1, 2)] == [0, 1]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, [float((k * 7) % 5), 1.0], f"2024-01-01 00:{k:02d}:00") for k in range(30)]
    df = spark.createDataFrame(rows, "set_id long, event_id long, embedding array<double>, t string").select("set_id", "event_id", F.to_timestamp("t").alias("ts"), "embedding")
    for n, part in enumerate([df.where("event_id < 10"), df.where("event_id BETWEEN 10 AND 19"), df.where("event_id > 19")]):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.online_clusters(ingest.files(spark, f"{tmp_path}/in", df.select("set_id", "event_id", "ts", "embedding").schema), 0.95)
    ingest.drain(ingest.into_batches(stream, f"{tmp_path}/out").outputMode("append"), f"{tmp_path}/state")
    found = {(r.set_id, r.event_id, r.cluster) for r in ingest.read_batches(spark, f"{tmp_path}/out", "set_id long, event_id long, cluster int").collect()}
    assert found == {(r.set_id, r.event_id, r.cluster) for r in clusters.online(df, "set_id", "event_id", 0.95).collect()}


def test_scores(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b", "c", "d"]), (2, [], [])], "id int, a array<string>, b array<string>")
    p, r, f = scoring.set_scores(F.col("a"), F.col("b"))
    assert [tuple(x) for x in df.select(F.round(p, 4), r, F.round(f, 4)).collect()] == [(0.3333, 0.5, 0.4), (0.0, 0.0, 0.0)]
    ranks = spark.createDataFrame([(1, k, k, 5 - k) for k in range(1, 5)], "q int, item int, rank_a int, rank_b int")
    assert scoring.kendall(ranks, ["q"]).first().tau == -1


def test_sources(spark, tmp_path):
    export = [{"id": "c", "title": "T", "create_time": 1.0, "mapping": {"n1": {"message": {"id": "m1", "author": {"role": "user"}, "content": {"content_type": "text", "parts": ["hello", "", "there"]}, "create_time": 1700000000.5}}, "n2": {"message": {"id": "m2", "author": {"role": "assistant"}, "content": {"content_type": "text", "parts": [" "]}, "create_time": 1.0}}, "n3": {"message": None}}}]
    (tmp_path / "chat.json").write_text(json.dumps(export))
    rows = chats.chat_export(spark, str(tmp_path / "chat.json")).collect()
    assert [(r.uid, r.role, r.content) for r in rows] == [("m1", "user", "hello\nthere")]
    archive = [{"conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "text": "hi"}, {"speaker": "B", "text": "yo"}], "session_1_date_time": "1:56 pm on 8 May, 2023"}}]
    (tmp_path / "arc.json").write_text(json.dumps(archive))
    rows = chats.session_archive(spark, str(tmp_path / "arc.json")).orderBy("turn").collect()
    assert [(r.session, r.producer_id, r.content) for r in rows] == [(1, "A", "hi"), (1, "B", "yo")]
    items = [{"question_id": "q", "question": "?", "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "x", "has_answer": True}, {"role": "assistant", "content": " "}]]}]
    (tmp_path / "lme.json").write_text(json.dumps(items))
    rows = chats.question_sessions(spark, str(tmp_path / "lme.json")).collect()
    assert [(r.session_id, r.has_answer, str(r.created_at)) for r in rows] == [("s1", True, "2023-05-20 02:21:00")]
    (tmp_path / "wiki.json").write_text(json.dumps({"question": "q", "answer": "a", "type": "t", "context": json.dumps([["T1", ["s1.", "s2."]], ["T2", ["x"]]]), "supporting_facts": json.dumps([["T1", 0]])}))
    assert [(r.title, r.content, r.supporting) for r in chats.passages(spark, str(tmp_path / "wiki.json")).collect()] == [("T1", "s1. s2.", True), ("T2", "x", False)]


def test_import_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", "user", "T", 1), ("b", "assistant", "T", 2), ("c", "user", "U", 3)], "uid string, role string, title string, n int").withColumn("created_at", F.timestamp_seconds("n"))
    assert [r.uid for r in chats.import_filter(df, limit=1, user_only=True).collect()] == ["a"]
    assert {r.uid for r in chats.resume(df, df.where("uid = 'a'")).collect()} == {"b", "c"}
    assert {r.uid for r in chats.resume(df, df, df.where("uid = 'c'")).collect()} == {"c"}
    chats.export_batches(df.drop("created_at"), f"{tmp_path}/out", ["n"], 1)
    assert spark.read.json(f"{tmp_path}/out").count() == 3
