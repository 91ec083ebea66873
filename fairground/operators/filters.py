"""Lookups, optional-field search filters, gates and eligibility."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from fairground.functions import text
from fairground.schemas import DEFAULT_CATEGORY


def lookup(df: DataFrame, **equals) -> DataFrame:
    """Rows equal on every given column; the predicates reach the scan."""
    for name, value in equals.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


@dataclass(frozen=True)
class SearchFilters:
    """Search constraints; a field left None (or falsy) does not constrain."""

    max_price: float | None = None
    city: str | None = None
    category: str | None = None
    genre: str | None = None
    duration: str | None = None
    start: str | None = None
    end: str | None = None

    def predicate(self) -> Column | None:
        terms = []
        if self.max_price:
            terms.append(F.col("price") <= self.max_price)
        for name in ("city", "category", "genre", "duration"):
            if getattr(self, name):
                terms.append(text.contains_ci(F.col(name), getattr(self, name)))
        if self.start:
            terms.append(F.col("date") >= F.lit(self.start))
        if self.end:
            terms.append(F.col("date") <= F.lit(self.end))
        out = None
        for term in terms:
            out = term if out is None else out & term
        return out

    def is_empty(self) -> bool:
        return not any(getattr(self, f.name) for f in fields(self))


def search_filter(df: DataFrame, filters: SearchFilters, relax: bool = True) -> DataFrame:
    """Rows matching every constraint; with ``relax``, all rows when nothing matches.

    Relaxing runs a probe job that stops at the first match, so that the scan proper gets the plain predicate.
    """
    predicate = filters.predicate()
    if predicate is None:
        return df
    matches = df.filter(predicate)
    if not relax:
        return matches
    return df if matches.isEmpty() else matches


def price_worklist(df: DataFrame, source: str) -> DataFrame:
    """Events of a source that still lack a price."""
    return df.filter((F.col("source") == source) & F.col("price").isNull()).select("url", "title", "uuid")


def quality_gate(df: DataFrame, floor: float = 3) -> DataFrame:
    """Drop summaries scored under ``floor``; unscored (null or 0) ones pass."""
    q = F.col("quality_score")
    return df.filter(q.isNull() | (q == 0) | (q >= floor))


def has_text(c: Column, longer_than: int = 10) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) > longer_than


def mark_enrichable(events: DataFrame, content: DataFrame, people: DataFrame, force: bool = False) -> DataFrame:
    """Add ``eligible``: a real description, or reviews, or known people, or ``force``."""
    with_reviews = content.select(F.col("event_uuid").alias("uuid")).distinct().withColumn("_reviews", F.lit(True))
    with_people = people.select(F.col("event_uuid").alias("uuid")).distinct().withColumn("_people", F.lit(True))
    flagged = events.join(with_reviews, "uuid", "left").join(with_people, "uuid", "left")
    known = F.coalesce(F.col("_reviews"), F.lit(False)) | F.coalesce(F.col("_people"), F.lit(False))
    eligible = has_text(F.col("description")) | known | F.lit(force)
    return flagged.withColumn("eligible", eligible).drop("_reviews", "_people")


def extractable(events: DataFrame, at_least: int = 20) -> DataFrame:
    """Events whose description is long enough for entity extraction."""
    return events.filter(F.length("description") >= at_least)


def specific_category(c: Column, generic: str = DEFAULT_CATEGORY) -> Column:
    """Neither missing nor the stand-in category."""
    return ~text.blank(c) & (c != generic)
