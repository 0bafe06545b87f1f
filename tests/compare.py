"""Runs queries and their SQL on the same tables and compares rows."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compared(spark, con, sf_dir: str, run, sql: str | None):
    """None if equal (or without SQL, if it runs), else what differs."""
    df = run(spark, sf_dir)
    names, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if rows else "no rows"
    result = con.sql(sql)
    wanted_names, wanted = rows_of(result.columns, result.fetchall())
    if names != wanted_names:
        return f"columns {names} / {wanted_names}"
    if rows != wanted:
        left, right = [r for r in rows if r not in set(wanted)][:3], [r for r in wanted if r not in set(rows)][:3]
        return f"{len(rows)} / {len(wanted)} rows; {left} / {right}"
    return "no rows" if not rows else None
