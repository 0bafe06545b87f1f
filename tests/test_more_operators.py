import datetime
import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ids, text
from palimpsest.operators import agents, features, longterm, rendering, rerank, search, segments, tables
from palimpsest.operators import sets as config
from palimpsest.sources.store import Conflict, TableStore


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_values(spark):
    assert one(spark, text.parsed_time(F.lit("1e300"))) is None
    assert one(spark, ids.partition_key(F.lit("abc\n"))) != "abc\n"
    assert text.last_object('{"a": "}"}') == '{"a": "}"}' and text.last_object('x { y {"b": 1}') == '{"b": 1}'
    assert text.last_object("no") is None and text.last_object("a } b") is None
    assert one(spark, text.some_ids(F.array(F.lit(" b ")), F.array(F.lit("a"), F.lit("")))) == ["a", "b"]
    with pytest.raises(Exception, match="at least one id"):
        one(spark, text.some_ids(F.array(F.lit(" "))))
    with pytest.raises(Exception, match="do not add up"):
        one(spark, text.regrouped(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))))


def test_packed():
    assert text.packed(["aa", "b", "ccc", "d"], 2, 4) == [["aa", "b"], ["ccc", "d"]] and text.packed([], 1, 1) == []
    with pytest.raises(ValueError):
        text.packed(["abc"], 2, 2)
    with pytest.raises(ValueError):
        text.packed([], 0, 2)


def test_upsert_does_not_depend_on_partitions(spark):
    old = spark.createDataFrame([(1, "a", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(1, v, 1) for v in "bcd"], "id int, v string, version int")
    found = {tables.upsert(old.repartition(n), new.repartition(n + 1), ["id"], "version").first().v for n in (1, 2, 3)}
    assert len(found) == 1 and found < set("bcd")


def test_search_beyond_the_broadcast(spark, monkeypatch):
    given = spark.range(60).select(F.col("id").alias("uid"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("embedding"))
    queries = given.where("uid < 20").select(F.col("uid").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = lambda: sorted(map(tuple, search.knn(queries, given, 3).select("query_id", "rank", "uid").collect()))
    wanted = rows()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 6)
    assert rows() == wanted and len(wanted) == 60


def test_tokens_without_stop_words(spark):
    assert one(spark, rerank.english_tokens(F.lit("It's the Cat, and a hat: don't!"))) == ["cat", "hat"]


def test_silent_and_continued_blocks(spark):
    at = datetime.datetime(2024, 1, 1, 13, 5)
    rows = [(1, 7, 0, 0, at, "ann", "text", 'say "é'), (1, 7, 0, 1, at, "ann", "text", " now"), (1, 7, 1, 0, at, None, "image", None), (1, 8, 0, 0, at, None, "text", "x")]
    given = spark.createDataFrame(rows, "c int, event_uid int, index int, offset int, ts timestamp, producer string, kind string, text string")
    assert rendering.contexts(given, ["c"], None, None).first().text == 'ann: "say \\"é now"\n[image]\n""\n"x"'
    assert rendering.contexts(given.where("event_uid = 8"), ["c"]).first().text.startswith("[Monday, January 1, 2024")


def test_segments_split(spark):
    events = spark.createDataFrame([(1, [("text", "one. " * 150), ("image", None)])], "uid int, blocks array<struct<kind:string,text:string>>")
    found = segments.split(events).orderBy("offset").collect()
    assert [(r["index"], r.offset) for r in found] == [(0, 0), (0, 1)] and all(len(r.text) <= 500 for r in found)


def test_agent_hits_above_one(spark):
    hits = spark.createDataFrame([(1, "a", 1)], "query_id int, uid string, rank int")
    none = hits.limit(0)
    assert longterm.with_agent_hits(hits, none, 1.1, ["query_id"]).count() == 0
    assert longterm.with_agent_hits(hits, none, 1.0, ["query_id"]).first().score == 1.0


def test_terms_are_merged_per_query(spark):
    long = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (1, "a", 1)], "query_id int, uid string, rank int")
    found = longterm.with_agent_hits(long, long.limit(0), 0.0, ["query_id"]).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == [(1, 1), (2, 1)]


def test_chain_stops_when_sufficient(spark):
    asked = []

    def tool(queries):
        asked.append(queries.count())
        return queries.select("query_id", F.concat("query_text", F.lit("!")).alias("uid"), F.lit(1).alias("created_at"), F.col("query_text").alias("content"))

    queries = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id int, query_text string")
    found = agents.chain_of_queries(tool, lambda q, texts: (q == "good", 0.9, q + "+"))(queries).collect()
    assert asked == [2, 1, 1] and sorted(r.uid for r in found) == sorted(["bad!", "bad++!", "bad+!", "good!"])


def test_consolidation_without_a_reply_changes_nothing(spark):
    f = spark.createDataFrame([("1", "s", "t", "f", "v")], "id string, set_id string, tag string, feature string, value string")
    c = spark.createDataFrame([("1", "h")], "feature_id string, history_id string")
    none = spark.createDataFrame([], "set_id string, tag string, keep array<string>, merged array<struct<id:string,feature:string,value:string>>")
    left, kept = features.consolidated(f, c, none, ["set_id", "tag"])
    assert left.collect() == f.collect() and kept.collect() == c.collect()


def test_types_without_tags_match_all(spark):
    entries = spark.createDataFrame([(1, ["a"]), (2, [])], "uid int, keys array<string>")
    types = spark.createDataFrame([(7, []), (8, ["a", "a"]), (9, ["a", "b"])], "type_id int, tags array<string>")
    assert sorted((r.uid, r.type_id) for r in config.matching_types(entries, types).collect()) == [(1, 7), (1, 8), (2, 7)]


def test_store_appends_and_conflicts(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    store.append("t", rows(1))
    store.append("t", rows(2, 3))
    assert store.versions("t") == [0] and sorted(r.x for r in store.read("t").collect()) == [1, 2, 3]
    store.change("t", lambda df: df.where("x <> 2"))
    store.append("t", rows(4))
    assert store.versions("t") == [0, 1] and sorted(r.x for r in store.read("t").collect()) == [1, 3, 4]
    with pytest.raises(Conflict):
        store.write("t", rows(9), after=0)
    store.compact("t")
    assert sorted(r.x for r in store.read("t").collect()) == [1, 3, 4]


@pytest.mark.parametrize("name", ["cluster_online", "stream_clusters"])
def test_online_clusters_against_a_plain_fold(spark, name):
    """Both queries over the small tables' vectors, against a fold written out: the most similar centroid, or a new cluster."""
    from palimpsest import catalogue

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    wanted = {}
    for label in {r.label for r in rows}:
        sums, counts = [], []
        for r in sorted((r for r in rows if r.label == label), key=lambda r: r.vec_id):
            v = [float(x) for x in r.embedding]
            best, place = -2.0, None
            for k, (s, n) in enumerate(zip(sums, counts)):
                c = [x / n for x in s]
                size = math.sqrt(sum(x * x for x in c)) * math.sqrt(sum(x * x for x in v))
                score = sum(x * y for x, y in zip(c, v)) / size if size else 0.0
                if score > best + 1e-12:
                    best, place = score, k
            if place is None or best < 0.15:
                sums.append([0.0] * len(v))
                counts.append(0)
                place = len(sums) - 1
            sums[place] = [x + y for x, y in zip(sums[place], v)]
            counts[place] += 1
            wanted[r.vec_id] = place
    found = catalogue.queries()[name](spark, sf).collect()
    assert {r[1]: r[2] for r in found} == wanted and len(found) == len(rows)


def test_resolvers(spark):
    from palimpsest.functions.properties import typed_map, typed_value
    from palimpsest.plans.filters import FilterError, compile_filter, feature_resolver, parse_filter, segment_resolver

    f = spark.createDataFrame([("s1", "c", "t", '{"a": "x"}'), ("s2", "c", "u", "{}")], "set_id string, category string, tag string, metadata string")
    where = lambda text: f.where(compile_filter(parse_filter(text), feature_resolver(f.columns)))
    assert where("set = s1 AND category_name = c AND m.a = x").count() == 1 and where("tag_id = u").count() == 1
    with pytest.raises(FilterError):
        where("uid = 3")
    s = spark.createDataFrame([(datetime.datetime(2024, 1, 1), 1), (datetime.datetime(2024, 1, 2), 2)], "ts timestamp, n int")
    s = s.withColumn("properties", typed_map({"a": typed_value("int", F.col("n").cast("bigint")), "_a": typed_value("str", F.lit("system"))}))
    where = lambda text: s.where(compile_filter(parse_filter(text), segment_resolver()))
    assert where("m.a = 2").count() == 1 and where("a = system").count() == 2 and where("timestamp > date('2024-01-01T12:00:00Z')").count() == 1


def test_benchmark_sources(spark, tmp_path):
    import json

    from palimpsest.sources import chats

    item = {"id": "1", "question": "q", "context": {"title": ["A", "B"], "sentences": [["a0", "a1"], ["b0"]]}, "supporting_facts": {"title": ["A", "B"], "sent_id": [1, 5]}}
    (tmp_path / "questions.json").write_text(json.dumps(item))
    rows = chats.titled_passages(spark, str(tmp_path / "questions.json")).orderBy("passage", "sentence").collect()
    assert [(r.title, r.content, r.supporting) for r in rows] == [("A", "a0", False), ("A", "a1", True), ("B", "b0", False)]
    message = lambda c, **more: {"role": "user", "content": c, **more}
    batches = [{"batch_number": 1, "turns": [[message("one", id=7), message("")], [message("two")]]}, {"batch_number": 2, "turns": [[{"content": "three", "role": "assistant", "time_anchor": "May"}]]}]
    start = datetime.datetime(2024, 1, 1)
    for name, data in (("flat", batches), ("plans", [{"plan-1": batches[:1], "other": 3}, {"plan-2": batches[1:]}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        rows = chats.batched_chat(spark, str(tmp_path / f"{name}.json"), start).orderBy("sequence_num").collect()
        assert [(r.content, r.batch_number, r.turn_index, r.producer_id, r.message_id, r.time_anchor) for r in rows] == [("one", "1", 0, "beam_user", "7", ""), ("two", "1", 1, "beam_user", "", ""), ("three", "2", 0, "beam_assistant", "", "May")]
        assert [(r.created_at - start).seconds for r in rows] == [1, 2, 3]


def test_newest_of_key_is_bounded_for_a_hot_key(spark):
    rows = [(k, f"t{k}", k // 2, "hot") for k in range(500)] + [(900, "c", 1, "cold"), (901, "n", 1, None)]
    tool = agents.newest_of_key(spark.createDataFrame(rows, "uid long, content string, created_at long, word string"), "word", F.col("query_text"), 3)
    queries = spark.createDataFrame([(1, "hot"), (2, "cold"), (3, "none"), (4, None), (5, "hot")], "query_id long, query_text string")
    found = sorted((r.query_id, r.uid) for r in tool(queries).collect())
    assert found == [(1, 497), (1, 498), (1, 499), (2, 900), (5, 497), (5, 498), (5, 499)]
    assert tool(queries).columns == ["query_id", "uid", "content", "created_at"]
