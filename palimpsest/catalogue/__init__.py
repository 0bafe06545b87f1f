"""Named queries with the SQL they are checked against."""

from __future__ import annotations

from . import config, features, filters, graph, ingestion, longterm, memory, scores, segments, slots, stores, streams, texts, vectors

MODULES = (filters, vectors, graph, features, memory, texts, scores, segments, longterm, config, ingestion, stores, streams, slots)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
