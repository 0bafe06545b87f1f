"""Text functions as Column expressions; lengths and positions are in characters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunks(text: Column, size: int) -> Column:
    """Pieces of `size` characters, the last one shorter; empty text has none."""
    if size <= 0:
        raise ValueError("the size must be positive")
    return _cut(text, F.lit(size))


def balanced_chunks(text: Column, size: int) -> Column:
    """As few pieces as chunks() needs, all of nearly the same length."""
    if size <= 0:
        raise ValueError("the size must be positive")
    pieces = F.ceil(F.length(text) / size)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(_cut(text, F.greatest(F.ceil(F.length(text) / pieces), F.lit(1)).cast("int")))


def _cut(text: Column, size: Column) -> Column:
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), size), lambda k: F.substring(text, k, size))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(whole)


def sentences(text: Column) -> Column:
    """Distinct sentences: within lines, up to a run of . ? ! or their wide forms; those without a letter or digit go."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[^.?!？！。\n\r]+[.?!？！。]*"), 0), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(r"[\p{L}\p{N}]")))


def json_quoted(text: Column) -> Column:
    """The text as a JSON string, non-ASCII kept."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def line(at: Column, who: Column, text: Column) -> Column:
    """[Weekday, Month dd, yyyy at hh:mm AM] who: "text"."""
    return F.concat(F.lit("["), F.date_format(at, "EEEE, MMMM dd, yyyy 'at' hh:mm a"), F.lit("] "), who, F.lit(": "), json_quoted(text))


_DATES = {"short": "M/d/yy", "medium": "MMM d, yyyy", "long": "MMMM d, yyyy", "full": "EEEE, MMMM d, yyyy"}
_TIMES = {"short": "h:mm a", "medium": "h:mm:ss a", "long": "h:mm:ss a", "full": "h:mm:ss a"}


def formatted(at: Column, date: str | None = None, time: str | None = None) -> Column:
    """A timestamp in the US styles short, medium, long or full; neither gives an empty text."""
    parts = [F.date_format(at, p) for p in (date and _DATES[date], time and _TIMES[time]) if p]
    return F.concat_ws(", ", *parts) if parts else F.lit("")


def parsed_time(text: Column) -> Column:
    """A timestamp of an ISO text, of seconds, or of milliseconds (beyond 1e12) since 1970; else null."""
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > 1e12, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros(F.round(seconds * 1_000_000).try_cast("bigint")), text.try_cast("timestamp"))


def seconds(epoch: Column) -> Column:
    """Epoch seconds of seconds or milliseconds (beyond 9,999,999,999)."""
    return F.when(epoch > 9_999_999_999, epoch / 1000).otherwise(epoch.cast("double"))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Distinct letters-and-digits tokens of 3 characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), 0))


def fact_variants(fact: Column) -> Column:
    """The fact, and what follows its first colon."""
    after = F.trim(F.substring(fact, F.locate(":", fact) + 1, F.length(fact)))
    return F.filter(F.array_distinct(F.array(normalised(fact), normalised(F.when(fact.contains(":"), after).otherwise(fact)))), lambda x: x != "")


def fact_in_text(fact: Column, text: Column, share: float = 0.6, least: int = 5) -> Column:
    """Whether a variant of the fact stands in the text, or a line of `least` tokens holds `share` of the fact's tokens."""
    whole = F.exists(fact_variants(fact), lambda v: normalised(text).contains(v))
    wanted = tokens(fact)
    near = lambda x: (F.size(tokens(x)) >= least) & (F.size(F.array_intersect(tokens(x), wanted)) >= F.size(wanted) * share)
    return whole | ((F.size(wanted) > 0) & F.exists(F.split(text, "\n"), near))


def tail(text: Column, n_tokens: int, chars_per_token: int = 4) -> Column:
    """The last tokens' worth of characters, from the first new line on where the text was cut."""
    n = n_tokens * chars_per_token
    cut = F.right(text, F.lit(n))
    at = F.locate("\n", cut)
    return F.when(F.length(text) <= n, text).otherwise(F.when(at > 0, F.substring(cut, at + 1, F.length(cut))).otherwise(cut))


def halves(text: Column) -> Column:
    middle = F.floor(F.length(text) / 2).cast("int")
    return F.array(F.substring(text, F.lit(1), middle), F.substring(text, middle + 1, F.length(text)))


def word_budget(capacity: Column | int) -> Column:
    """Words of a summary: half the capacity at 8 characters a word, up to the next hundred."""
    given = F.lit(capacity) if isinstance(capacity, int) else capacity
    return (F.ceil(F.floor(given / 2 / 8) / 100) * 100).cast("int")


def ids(values: Column) -> Column:
    """Trimmed, distinct, sorted ids; blank ones go (see some_ids)."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")))


def some_ids(*values: Column) -> Column:
    """ids() of all the arrays together; raises where none is left."""
    whole = ids(F.flatten(F.array(*[F.coalesce(v, F.array().cast("array<string>")) for v in values])))
    return F.when(F.size(whole) > 0, whole).otherwise(F.raise_error(F.lit("at least one id is needed")))


# The separators of the recursive splitter, the strongest first; the empty one cuts anywhere.
SEPARATORS = (
    "\n\n", "],\n", "},\n", "),\n", "]\n", "}\n", ")\n", ",\n", "？\n", "?\n", "！\n", "!\n", "。\n", ".\n", "？", "? ", "！", "! ", "。", ". ", "; ", ": ",
    "\u2014", "--", "，", "、", ", ", "\u200b", " ", "",
)


def split_text(text: str, most: int = 500, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `most` characters, cut at the strongest separator that is there; separators stay at piece ends, outer white space goes.

    A part that is too long alone is cut by the weaker separators; its pieces are not joined to what follows.
    """
    if not text:
        return []
    at = next(k for k, s in enumerate(separators) if s in text)
    sep = separators[at]
    parts = text.split(sep) if sep else list(text)
    parts = [p + sep for p in parts[:-1]] + [parts[-1]]
    out: list[str] = []
    current = ""

    def close() -> None:
        if piece := current.strip():
            out.append(piece)

    for part in parts:
        if len(part) >= most and sep:
            close()
            current = ""
            out += split_text(part, most, separators[at + 1 :])
        elif len(current) + len(part) > most:
            close()
            current = part
        else:
            current += part
    close()
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def segments(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """split_text over a column."""
    for s in texts:
        yield s.map(lambda t: split_text(t or ""))


def word_chunks(text: str, most: int = 3000) -> list[str]:
    """Pieces of at most `most` characters, cut at the last space if that is past the half; trimmed, blank ones go."""
    out = []
    while text:
        cut = len(text)
        if cut > most:
            space = text.rfind(" ", 0, most)
            cut = space if space > most // 2 else most
        if piece := text[:cut].strip():
            out.append(piece)
        text = text[cut:]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_chunked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: word_chunks(t or ""))


def last_object(reply: str) -> str | None:
    """The last {...} of a reply: back from the last brace that closes to the one that opens it; braces inside JSON strings do not count where that gives an object."""
    end = reply.rfind("}")
    if end < 0:
        return None
    decoder = json.JSONDecoder()
    starts = [k for k, c in enumerate(reply[: end + 1]) if c == "{"]
    for k in starts:  # the first start from which JSON reaches the last closing brace holds the rest
        try:
            if k + decoder.raw_decode(reply[k:])[1] == end + 1:
                return reply[k : end + 1]
        except ValueError:
            continue
    depth = 0
    for k in range(end, -1, -1):
        depth += (reply[k] == "}") - (reply[k] == "{")
        if depth == 0:
            return reply[k : end + 1]
    return None


def reply_lines(reply: Column) -> Column:
    """The trimmed lines of a reply that are not blank."""
    return F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def packed(texts: list[str], most: int, most_chars: int) -> list[list[str]]:
    """Texts in runs of at most `most`, of at most most_chars characters together; a longer text raises."""
    if most <= 0 or most_chars <= 0:
        raise ValueError("the bounds must be positive")
    out: list[list[str]] = []
    used = 0
    for text in texts:
        if len(text) > most_chars:
            raise ValueError(f"a text of {len(text)} characters is longer than {most_chars}")
        if not out or len(out[-1]) >= most or used + len(text) > most_chars:
            out.append([])
            used = 0
        out[-1].append(text)
        used += len(text)
    return out


def packed_array(texts: Column, most: int, most_chars: int) -> Column:
    """packed() over an array column."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: packed(list(x), most, most_chars) if x is not None else None)

    return run(texts)


def regrouped(flat: Column, sizes: Column) -> Column:
    """A flat list as lists of the given sizes; raises unless the sizes add up to its length."""
    total = F.aggregate(sizes, F.lit(0), lambda s, x: s + x)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1))), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda s, x: s + x))
    lists = F.zip_with(sizes, ends, lambda n, end: F.slice(flat, end - n + 1, n))
    none = F.when(F.size(sizes) == 0, F.slice(F.array(flat), F.lit(1), F.lit(0))).otherwise(lists)
    return F.when(total == F.size(flat), none).otherwise(F.raise_error(F.lit("the sizes do not add up to the list's length")))
