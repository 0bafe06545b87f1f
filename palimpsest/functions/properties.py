"""Typed property maps, and JSON at their edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.plans.filters import TYPED

_FIELDS = ("b", "i", "f", "s", "ts")
_SQL = {"bool": ("b", "boolean"), "int": ("i", "bigint"), "float": ("f", "double"), "str": ("s", "string"), "datetime": ("ts", "timestamp")}


def typed_value(kind: str, value: Column, offset_seconds: Column | None = None) -> Column:
    """One entry of a typed map; null where the value is null."""
    name, sql = _SQL[kind]
    types = {v[0]: v[1] for v in _SQL.values()}
    fields = [F.lit(kind).alias("t"), *[(value if f == name else F.lit(None)).cast(types[f]).alias(f) for f in _FIELDS], (F.lit(None) if offset_seconds is None else offset_seconds).cast("int").alias("tz")]
    return F.when(value.isNotNull(), F.struct(*fields))


def typed_map(entries: dict[str, Column]) -> Column:
    """A typed map of entries made by typed_value; entries that are null are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).cast(TYPED)


def encode(properties: Column) -> Column:
    """JSON text {"key": {"t", "v"[, "tz"]}} of a typed map; times are ISO texts in UTC."""
    iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    text = lambda x: F.coalesce(x["b"].cast("string"), x["i"].cast("string"), x["f"].cast("string"), x["s"], iso(x["ts"]))
    return F.to_json(F.transform_values(properties, lambda _, x: F.struct(x["t"].alias("t"), text(x).alias("v"), x["tz"].alias("tz"))))


def decode(text: Column) -> Column:
    """The typed map of encode()'s text; null and unreadable texts give null."""
    raw = F.from_json(text, "map<string,struct<t:string,v:string,tz:int>>")
    part = lambda x, kind: F.when(x["t"] == kind, x["v"].try_cast(_SQL[kind][1])).alias(_SQL[kind][0])
    return F.transform_values(raw, lambda _, x: F.struct(x["t"].alias("t"), *[part(x, k) for k in _SQL], x["tz"].alias("tz"))).cast(TYPED)


def scalars_only(metadata: Column) -> Column:
    """Of a JSON object the keys whose values are no objects, arrays or nulls, as a map of texts."""
    found = F.from_json(metadata, "map<string,string>")
    return F.map_filter(found, lambda _, v: v.isNotNull() & ~F.substring(F.trim(v), 1, 1).isin("{", "["))


def stringified(metadata: Column) -> Column:
    """A map of texts of a JSON object; nulls are dropped."""
    return F.map_filter(F.from_json(metadata, "map<string,string>"), lambda _, v: v.isNotNull())


def contains(metadata: Column, wanted: dict[str, str]) -> Column:
    """Whether a JSON object holds all the given texts."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (F.get_json_object(metadata, f"$.{k}") == F.lit(v))
    return out
