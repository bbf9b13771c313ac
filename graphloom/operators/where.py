"""The `where` language of object queries, compiled to Column predicates.

A clause is a list of conditions joined by commas; all must hold. `key=value` (or `key:value`) compares text, `key~value` looks
for text without regard to case. Values are typeless: numbers and booleans compare by their text, null reads `null`, a column
that the table lacks reads `undefined`. On arrays, `=` asks for a member and `~` for a member that contains the text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

#: What stands for a nested value where text is asked for.
OBJECT_TEXT = "[object Object]"


def parse_where(text: str | None) -> list[tuple[str, str, str]]:
    """(key, operator, value) of each condition; parts without an operator or a key are ignored."""
    found = (re.match(r"([^=:~]*)([=:~])(.*)", part, re.S) for part in (text or "").split(","))
    return [(m[1].strip(), "~" if m[2] == "~" else "=", m[3].strip()) for m in found if m and m[1].strip()]


def condition(df: DataFrame, key: str, operator: str, value: str) -> Column:
    kind = df.schema[key].dataType if key in df.columns else None
    if kind is None:
        return F.lit(value.lower() in "" if operator == "~" else value == "undefined")
    column = F.col(f"`{key}`")
    if isinstance(kind, ArrayType):
        if operator == "=":
            member = F.array_contains(column, value) if isinstance(kind.elementType, StringType) else F.lit(False)
            return F.coalesce(member, F.lit(False))
        text = (lambda x: F.lit(OBJECT_TEXT)) if isinstance(kind.elementType, StructType) else (lambda x: x.cast("string"))
        return F.coalesce(F.exists(column, lambda x: F.contains(F.lower(F.coalesce(text(x), F.lit(""))), F.lit(value.lower()))), F.lit(False))
    text = F.when(column.isNotNull(), OBJECT_TEXT) if isinstance(kind, StructType | MapType) else column.cast("string")
    if operator == "=":
        return F.coalesce(text, F.lit("null")) == value
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(value.lower()))


def where(df: DataFrame, text: str | None) -> DataFrame:
    conditions = [condition(df, *c) for c in parse_where(text)]
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def query(df: DataFrame, text: str | None = None, order: str = "_ord", limit: int | None = 50) -> DataFrame:
    """The first `limit` matches in the table's order; None for all. A negative limit drops as many from the end."""
    found = where(df, text)
    if limit is None:
        return found
    if limit < 0:
        limit = max(0, found.count() + limit)
    return found.orderBy(order).limit(limit)
