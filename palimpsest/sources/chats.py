"""Conversation sources: chat exports, session archives and benchmark files, as message rows; filters and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.tables import numbered

CHAT_EXPORT = "id string, title string, create_time double, mapping map<string, struct<message: struct<id: string, author: struct<role: string>, content: struct<content_type: string, parts: array<string>>, create_time: double>>>"


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a chat export (a JSON array): text parts joined; blank ones and those without a time are left out."""
    raw = spark.read.schema(CHAT_EXPORT).json(path, multiLine=True)
    found = raw.select(F.col("id").alias("chat_id"), "title", F.explode(F.map_values("mapping")).alias("node")).select("chat_id", "title", "node.message.*")
    text = F.array_join(F.filter(F.col("content.parts"), lambda p: F.trim(p) != ""), "\n")
    rows = found.select("chat_id", "title", F.col("id").alias("uid"), F.col("author.role").alias("role"), text.alias("content"), F.timestamp_micros((F.col("create_time") * 1_000_000).cast("bigint")).alias("created_at"))
    return rows.where((F.trim("content") != "") & F.col("created_at").isNotNull())


def session_archive(spark: SparkSession, path: str, pattern: str = "h:mm a 'on' d MMMM, yyyy") -> DataFrame:
    """Messages of archives {"conversation": {"session_n": [{speaker, text}], "session_n_date_time": text}}, a second apart."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<conversation: map<string,string>>>").alias("all"))
    samples = raw.select(F.posexplode("all").alias("sample", "x")).select("sample", F.col("x.conversation").alias("c"))
    pairs = samples.select("sample", "c", F.explode("c").alias("key", "value")).where(F.col("key").rlike(r"^session_\d+$"))
    at = F.element_at("c", F.concat("key", F.lit("_date_time")))
    turns = pairs.select("sample", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), at.alias("at"), F.posexplode(F.from_json("value", "array<struct<speaker:string,text:string>>")).alias("turn", "m"))
    start = F.try_to_timestamp(F.upper("at"), F.lit(pattern))
    start = F.coalesce(start, F.try_to_timestamp("at", F.lit(pattern)))
    return turns.select("sample", "session", "turn", F.col("m.speaker").alias("producer_id"), F.col("m.text").alias("content"), (start + F.make_interval(secs=F.col("turn"))).alias("created_at"))


def question_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Turns of question items with haystack sessions; each turn a second after the one before."""
    schema = "question_id string, question string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    sessions = raw.select("question_id", "question", "haystack_dates", "haystack_session_ids", F.posexplode("haystack_sessions").alias("session", "turns"))
    turns = sessions.select("question_id", F.get("haystack_session_ids", "session").alias("session_id"), F.get("haystack_dates", "session").alias("at"), F.posexplode("turns").alias("turn", "m"))
    start = F.try_to_timestamp(F.regexp_replace("at", r" \([A-Za-z]+\)", ""), F.lit("yyyy/MM/dd HH:mm"))
    return turns.select("question_id", "session_id", "turn", "m.role", "m.content", F.coalesce("m.has_answer", F.lit(False)).alias("has_answer"), (start + F.make_interval(secs=F.col("turn"))).alias("created_at")).where(F.trim("content") != "")


def passages(spark: SparkSession, path: str) -> DataFrame:
    """Titled passages of question lines whose context is JSON [[title, [sentences]]]; supporting where the facts name the title."""
    raw = spark.read.schema("question string, answer string, type string, context string, supporting_facts string").json(path)
    found = raw.select("question", F.from_json("supporting_facts", "array<array<string>>").alias("facts"), F.explode(F.from_json("context", "array<array<string>>")).alias("p"))
    text = F.array_join(F.from_json(F.col("p")[1], "array<string>"), " ")
    return found.select("question", F.col("p")[0].alias("title"), text.alias("content"), F.exists("facts", lambda f: f[0] == F.col("p")[0]).alias("supporting"))


def titled_passages(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of question lines whose context is {title: [...], sentences: [[...]]}: one row each, supporting where the facts name title and number."""
    schema = "id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>"
    raw = spark.read.schema(schema).json(path)
    facts = F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sentence"))
    passages = raw.select("id", "question", "answer", "level", facts.alias("facts"), F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))).alias("passage", "p"))
    rows = passages.select("id", "question", "answer", "level", "passage", F.col("p.title").alias("title"), "facts", F.posexplode("p.sentences").alias("sentence", "content"))
    named = F.exists("facts", lambda f: (f["title"] == F.col("title")) & (f["sentence"] == F.col("sentence")))
    return rows.select("id", "question", "answer", "level", "passage", "title", "sentence", "content", F.coalesce(named, F.lit(False)).alias("supporting"))


def batched_chat(spark: SparkSession, path: str, start) -> DataFrame:
    """Messages of a chat in batches of turns, a second apart from `start` on.

    The file is a list of batches {batch_number, turns: [[message]]}, or of objects
    whose plan-... keys hold such lists, in their order. Messages without content are
    left out. The order of a file is kept by a number per file, so one file is one chat.
    """
    batch = "struct<batch_number:string,turns:array<array<struct<role:string,content:string,id:string,time_anchor:string,question_type:string,index:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    items = raw.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("item", "json"))
    plans = F.filter(F.json_object_keys("json"), lambda k: k.startswith("plan-"))
    nested = items.select("file", "item", "json", F.posexplode(plans).alias("plan", "key"))
    nested = nested.select("file", "item", "plan", F.posexplode(F.from_json(F.element_at(F.from_json("json", "map<string,string>"), F.col("key")), f"array<{batch}>")).alias("at", "b"))
    flat = items.where(F.size(plans) == 0).select("file", "item", F.lit(0).alias("plan"), F.lit(0).alias("at"), F.from_json("json", batch).alias("b"))
    batches = nested.unionByName(flat)
    turns = batches.select("file", "item", "plan", "at", F.coalesce("b.batch_number", F.lit("0")).alias("batch_number"), F.posexplode("b.turns").alias("turn", "messages"))
    rows = turns.select("file", "item", "plan", "at", "batch_number", "turn", F.posexplode("messages").alias("place", "m")).where(F.col("m.content") != "")
    order = W.partitionBy("file").orderBy("item", "plan", "at", "turn", "place")
    n = F.row_number().over(order)
    role = F.coalesce("m.role", F.lit("user"))
    return rows.select(
        "file", n.alias("sequence_num"), F.concat(F.lit("beam_"), role).alias("producer_id"), role.alias("producer_role"), F.col("m.content").alias("content"), (F.lit(start) + F.make_interval(secs=n)).alias("created_at"), "batch_number",
        F.col("turn").alias("turn_index"), *[F.coalesce(f"m.{c}", F.lit("")).alias(name) for c, name in (("id", "message_id"), ("time_anchor", "time_anchor"), ("question_type", "question_type"), ("index", "index"))],
    )


def import_filter(messages: DataFrame, since=None, limit: int | None = None, title: str | None = None, user_only: bool = False) -> DataFrame:
    """Messages to import, oldest first."""
    found = messages
    if since is not None:
        found = found.where(F.col("created_at") >= F.lit(since))
    if title is not None:
        found = found.where(F.col("title") == title)
    if user_only:
        found = found.where("role = 'user'")
    return found if limit is None else found.orderBy("created_at", "uid").limit(limit)


def resume(messages: DataFrame, succeeded: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """What is left to import; with failures given, only those are tried again."""
    if failed is not None:
        return messages.join(failed.select("uid").distinct(), "uid", "left_semi")
    return messages.join(succeeded.select("uid").distinct(), "uid", "left_anti")


def export_batches(messages: DataFrame, path: str, order: list[str], per_file: int = 1000) -> None:
    """JSON batches batch=0, 1, ... of per_file rows each, in order; the last one may be shorter."""
    rows = numbered(messages, order).withColumn("batch", F.floor(F.col("number") / per_file).cast("long"))
    rows.repartition("batch").sortWithinPartitions("batch", "number").drop("number").write.partitionBy("batch").json(path)
