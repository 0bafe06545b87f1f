"""Timestamps in the styles of a locale and in a zone, as JVM expressions.

Patterns are those of the JVM's own locale data, looked up once for a style and a
locale; names of months, days and zones come from there as well. So every locale
that the JVM knows will do, and no row goes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

STYLES = ("short", "medium", "long", "full")


def pattern(spark: SparkSession, date: str | None, time: str | None, locale: str = "en_US") -> str:
    """The pattern of a date style and a time style; how both are joined goes by the longer one. Neither gives an empty pattern."""
    for style in (date, time):
        if style is not None and style not in STYLES:
            raise ValueError(f"unknown style {style!r}")
    jvm = spark._jvm.java
    where = jvm.util.Locale.forLanguageTag(locale.replace("_", "-"))
    iso = jvm.time.chrono.IsoChronology.INSTANCE
    style_of = lambda s: None if s is None else jvm.time.format.FormatStyle.valueOf(s.upper())
    find = lambda d, t: jvm.time.format.DateTimeFormatterBuilder.getLocalizedDateTimePattern(style_of(d), style_of(t), iso, where)
    if date is None or time is None:
        return find(date, time) if date or time else ""
    longer = max(date, time, key=STYLES.index)
    parts = {x: find(x, None) for x in (date, longer)}, {x: find(None, x) for x in (time, longer)}
    joined = find(longer, longer)
    at, to = joined.index(parts[0][longer]), joined.index(parts[1][longer])
    if at > to:
        raise ValueError(f"{locale} puts the time first")
    return joined[:at] + parts[0][date] + joined[at + len(parts[0][longer]) : to] + parts[1][time] + joined[to + len(parts[1][longer]) :]


def formatted(spark: SparkSession, at: Column, date: str | None = "full", time: str | None = "long", locale: str = "en_US", zone: str | None = None) -> Column:
    """A timestamp as text; without styles an empty one, without a zone in the session's zone. Null stays null."""
    form = pattern(spark, date, time, locale)
    if not form:
        return F.when(at.isNotNull(), F.lit(""))
    options = {"timestampFormat": form, "locale": locale.replace("_", "-")} | ({"timeZone": zone} if zone else {})
    return F.get_json_object(F.to_json(F.struct(at.cast("timestamp").alias("v")), options), "$.v")
