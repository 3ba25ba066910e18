"""Identifier resolution and pagination."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import any_of


def resolve(nodes: DataFrame, value: str, exact: list[str], folded: list[str] = (), prefix: list[str] = ()) -> DataFrame:
    """Nodes with the value in one of the exact columns, case-folded in the folded ones, as a prefix in others."""
    conditions = [F.col(c).cast("string") == value for c in exact]
    conditions += [F.lower(c) == value.lower() for c in folded]
    conditions += [F.lower(c).startswith(value.lower()) for c in prefix]
    return nodes.filter(any_of(conditions))


def first_of(branches: list[DataFrame], key: str) -> DataFrame:
    """One row: of the first branch that has any, the one with the least key. Each branch gives one row at most."""
    out = None
    for i, branch in enumerate(branches):
        one = branch.orderBy(key).limit(1).withColumn("priority", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("priority").limit(1).drop("priority")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit) if offset else rows.orderBy(*order).limit(limit)


def cursor_of(occurred_at: str, id_: int) -> str:
    """A place in the order as text: a check sum, the id and the time, as in 0f3c9a71.100.2024-01-20T00:00:00."""
    place = f"{id_}.{occurred_at}"
    return f"{zlib.crc32(place.encode()):08x}.{place}"


def cursor_parts(cursor: str) -> tuple[str, int]:
    """The place a cursor stands for; ValueError for one that was cut or changed."""
    _, _, place = cursor.partition(".")
    id_, _, occurred_at = place.partition(".")
    if not id_.lstrip("-").isdecimal() or cursor_of(occurred_at, int(id_)) != cursor:
        raise ValueError("malformed cursor")
    return occurred_at, int(id_)


def keyset_page(rows: DataFrame, time: str, id_: str, limit: int, cursor: str | None = None) -> DataFrame:
    """Newest first, after the cursor; one row more than the limit shows that there is a next page."""
    if cursor is not None:
        at, last = cursor_parts(cursor)
        rows = rows.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(id_) < last)))
    return rows.orderBy(F.col(time).desc(), F.col(id_).desc()).limit(limit + 1)
