"""Identifiers that are the same on every replay."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def partition_key(session: Column) -> Column:
    """The session key where it is a legal partition key, else 32 hex digits of its SHA-256."""
    legal = session.rlike(r"\A[a-z0-9_]+\z") & (F.length(session) <= 32)
    return F.when(legal, session).otherwise(F.substring(F.sha2(session, 256), 1, 32))


def input_hash(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", ids), 256)


def child_id(parent: Column, part: Column) -> Column:
    """16 hex digits of a cluster's part."""
    return F.substring(F.sha2(F.concat_ws(":", parent, part.cast("string")), 256), 1, 16)


def shake(tags: list[str]) -> str:
    """12 hex digits of the sorted tags."""
    return hashlib.shake_256("".join(sorted(tags)).encode()).hexdigest(6)


def set_id(kind: str, org: Column, project: Column | None, tags: dict[str, Column]) -> Column:
    """mem_{kind}_{org}[_project_{project}]_{n tags}_{hash of tag names}__{name_value of each tag, sorted}."""
    parts = [F.lit(f"mem_{kind}_org_"), org]
    if project is not None:
        parts += [F.lit("_project_"), project]
    pairs = [F.concat(F.lit(f"{k}_"), tags[k]) for k in sorted(tags)]
    return F.concat(*parts, F.lit(f"_{len(tags)}_{shake(list(tags))}__"), F.concat_ws("_", *pairs))


def uuid5(names: Column, namespace: uuid.UUID) -> Column:
    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda x: None if x is None else str(uuid.uuid5(namespace, x)))

    return run(names)
