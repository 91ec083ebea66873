"""Whitespace, truncation, matching and label text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Phrases that mark a summary written without any content.
BOILERPLATE = ("no reviews available", "impossible to gauge", "no description")


def clean_text(c: Column, empty_to_null: bool = False) -> Column:
    """Collapse whitespace runs and trim. Null stays null unless ``empty_to_null`` is False, when it becomes ''."""
    text = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.nullif(text, F.lit("")) if empty_to_null else F.coalesce(text, F.lit(""))


def normalize_spaces(c: Column) -> Column:
    """Collapse whitespace runs; null and '' pass through unchanged."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    """True for null or ''."""
    return c.isNull() | (c == "")


def or_default(c: Column, default: str) -> Column:
    """``c`` unless it is null or ''."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(needle)))


def truncate(c: Column, size: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(suffix))).otherwise(c)


def title_label(c: Column) -> Column:
    """``price_outlier`` -> ``Price Outlier``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def is_boilerplate(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in BOILERPLATE])


def embedding_text(title: Column, venue: Column, category: Column, description: Column) -> Column:
    """'title. venue. category. description', absent parts left empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, venue, category, description)]
    return F.concat_ws(". ", *parts)


def date_span(dates: Column, single: Column) -> Column:
    """'first to last (n shows)' for two or more dates, else ``single``."""
    many = F.format_string("%s to %s (%d shows)", F.array_min(dates), F.array_max(dates), F.size(dates))
    return F.when(F.size(dates) > 1, many).otherwise(single)
