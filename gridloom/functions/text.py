"""Small text helpers as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"^[\p{Punct}…]+$"


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})")


def is_punctuation(value: Column) -> Column:
    return value.rlike(PUNCTUATION)


def join_items(items: Column, sep: str = " ") -> Column:
    """Items that are not null, joined; null for an empty list."""
    return F.when(F.size(items) > 0, F.array_join(items, sep))


def strip_pound(value: Column) -> Column:
    return F.regexp_replace(value, "^#", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
