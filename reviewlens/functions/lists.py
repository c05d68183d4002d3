"""Array column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_array(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def safe_list(col: Column) -> Column:
    """The list, or an empty one."""
    return F.coalesce(col, text_array())


def parse_list(col: Column) -> Column:
    """Decode a list written as text; anything unreadable gives an empty list."""
    return safe_list(F.from_json(col, "array<string>", {"allowSingleQuotes": "true"}))


def or_default(col: Column, default: str) -> Column:
    """The list, or a one-item list when it is empty."""
    return F.when(F.size(safe_list(col)) > 0, col).otherwise(text_array(default))


def first_items(col: Column, n: int) -> Column:
    return F.slice(safe_list(col), 1, n)


def pretty_json(col: Column) -> Column:
    """A struct as indented JSON text."""
    return F.to_json(col, {"pretty": "true"})
