"""Slots for models: embedders, language models, derivers and payload codecs are functions over lists; requests are batched by Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X

#: Marks of models that are no text.
SPECIAL = r"<\|[a-z_]+\|>"


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str, text: str = "text", most_chars: int = 8000, most_texts: int = 256, most_request: int = 200_000) -> DataFrame:
    """key and embedding of each text: special marks go, an empty text stands as ".", a long one is cut into balanced chunks whose vectors are averaged.

    embed gets lists of at most most_texts chunks and most_request characters.
    """

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            vectors = [v for request in X.packed(list(s), most_texts, max(most_request, most_chars)) for v in embed(request)]
            yield pd.Series([[float(x) for x in v] for v in vectors])

    cleaned = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPECIAL, ""))
    whole = F.when(cleaned == "", F.lit(".")).otherwise(cleaned)
    chunks = df.select(F.col(key), F.explode(X.balanced_chunks(whole, most_chars)).alias("chunk")).withColumn("vector", run("chunk"))
    places = chunks.select(key, F.posexplode("vector").alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    return places.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("embedding"))


def generated(prompt: Column, generate: Callable[[str], tuple[str, int, int]]) -> Column:
    """struct(reply, tokens_in, tokens_out) of a language model for each prompt."""

    @F.pandas_udf("reply string, tokens_in long, tokens_out long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([generate(p or "") for p in s], columns=["reply", "tokens_in", "tokens_out"])

    return run(prompt)


def parsed_reply(reply: Column, schema: str) -> Column:
    """The last JSON object of a reply by a schema; null where there is none or it does not fit."""
    last = F.udf(lambda t: None if t is None else X.last_object(t), "string")
    return F.from_json(last(reply), schema)


def derived(df: DataFrame, derive: Callable[[str], list[str]], key: str, text: str = "text") -> DataFrame:
    """key, n, text: what a deriver makes of each text, none or several."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: list(derive(t or "")))

    return df.select(F.col(key), F.posexplode(run(text)).alias("n", "text"))


def segmented(events: DataFrame, segment: Callable[[str], list[str]], event: str, index: str = "index", text: str = "text") -> DataFrame:
    """event, index, offset, text, uid: what a segmenter makes of each block of an event, in order; a block without text gives none.

    uid is that of event, block and place, so that a replay gives the same segments.
    """

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: [] if t is None else list(segment(t)))

    rows = events.select(F.col(event), F.col(index).alias("index"), F.posexplode(run(text)).alias("offset", "text"))
    return rows.withColumn("uid", F.sha2(F.concat_ws("|", F.col(event).cast("string"), "index", "offset"), 256))


def coded(payload: Column, code: Callable[[bytes], bytes]) -> Column:
    """A binary column through a payload codec, one way or the other; null stays null."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else code(bytes(x)))

    return run(payload.cast("binary"))
