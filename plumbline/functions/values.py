"""Expressions over columns of values and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import ESCAPES

BLANK = r"[\s\p{Z}]+"


def clean_value(value: Column) -> Column:
    """A value without surrounding blanks, in lower case."""
    return F.lower(F.regexp_replace(value, f"^{BLANK}|{BLANK}$", ""))


def clean_values(values: Column) -> Column:
    """The distinct cleaned values of an array; null and blank ones are dropped, a null array is empty."""
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_value)
    return F.array_distinct(F.filter(cleaned, lambda v: v.isNotNull() & (v != "")))


def escape_html_column(text: Column) -> Column:
    """``text.escape_html`` of a column."""
    for ch, entity in ESCAPES.items():
        text = F.replace(text, F.lit(ch), F.lit(entity))
    return text


def unescape_html_column(text: Column) -> Column:
    """``text.unescape_html`` of a column."""
    for ch, entity in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return text
