"""Projections that fix types and defaults once, so every later operator sees the same semantics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fairground.functions import prices, replies, text
from fairground.schemas import DEFAULT_CATEGORY


def normalize_events(df: DataFrame) -> DataFrame:
    """Analysis frame: missing or falsy price -> 0.0, missing category/venue -> 'unknown', date parts added.

    ``day_of_week`` counts from Monday = 0. A ``date`` that is text is cast, unparsable dates become null.
    """
    price = F.col("price").try_cast("double")
    ts = F.col("date").try_cast("timestamp")
    out = df.withColumn("price", F.when(price.isNull() | F.isnan(price), F.lit(0.0)).otherwise(price))
    out = out.withColumns({
        "category": text.or_default(F.col("category"), "unknown"),
        "venue": text.or_default(F.col("venue"), "unknown"),
        "description": F.coalesce(F.col("description"), F.lit("")),
        "date": ts,
        "month": F.month(ts),
        "day_of_week": F.weekday(ts),
        "hour": F.hour(ts),
    })
    return out.withColumns({
        "has_description": F.col("description") != "",
        "description_length": F.length("description"),
    })


def priced(df: DataFrame) -> DataFrame:
    """Rows with a price above zero: free and unpriced events stay out of price statistics."""
    return df.filter(F.col("price") > 0)


# What storage writes for a missing value. Price has no default: it stays null.
EVENT_DEFAULTS: Mapping[str, object] = {
    "title": "", "description": "", "date_raw": "", "venue": "", "city": "", "price_range": "", "url": "",
    "image_url": "", "category": DEFAULT_CATEGORY, "genre": "", "duration": "", "source": "", "ai_score": 0.0,
}
CONTENT_DEFAULTS: Mapping[str, object] = {
    "text": "", "summary": "", "rating": 0.0, "rating_count": 0, "author": "", "language": "tr",
    "sentiment_score": 0.0, "likes_count": 0, "views_count": 0, "helpful_count": 0,
}
VENUE_DEFAULTS: Mapping[str, object] = {
    "city": "", "address": "", "coordinates": "", "is_outdoors": False, "capacity": 0, "vibe": "",
}
PERSON_DEFAULTS: Mapping[str, object] = {"name": "", "known_for": ""}


def collapse_nulls(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace null by the storage default, column by column; columns without a default are untouched."""
    present = {n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items() if n in df.columns}
    return df.withColumns(present) if present else df


def validate_items(df: DataFrame, default_source: str, max_price: float = prices.MAX_PRICE) -> DataFrame:
    """Add ``reject_reason`` (null for accepted rows), clean the price and default the source.

    A falsy price (0, '') is left alone, as is null; a price that is no number, negative or above ``max_price``
    becomes null. Split the result on ``reject_reason``: rejected rows are kept for a side output.
    """
    raw = F.col("price")
    falsy = raw.isNull() | (raw.cast("string") == "")
    checked = F.when(falsy, None).otherwise(prices.valid_price(raw, max_price))
    return df.withColumns({
        "price": checked,
        "source": text.or_default(F.col("source"), default_source),
        "reject_reason": F.when(text.blank(F.col("title")), F.lit("Missing title")),
    })


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())


def display_card(df: DataFrame) -> DataFrame:
    """Dashboard card: defaults for absent fields, summary cut to 200 characters for display."""
    return df.select(
        text.or_default(F.col("title"), "Unknown Event").alias("title"),
        F.coalesce(F.col("price"), F.lit(0.0)).alias("price"),
        text.or_default(F.col("venue"), "TBA").alias("venue"),
        text.or_default(F.col("category"), DEFAULT_CATEGORY).alias("category"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        F.coalesce(text.truncate(F.col("sentiment_summary"), 200), F.lit("")).alias("summary"),
        F.coalesce(F.col("quality_score"), F.lit(0.0)).alias("quality_score"),
    )


def short_title(c: Column, size: int = 50) -> Column:
    return text.truncate(text.or_default(c, "Unknown Event"), size)


def compact_summary(df: DataFrame) -> DataFrame:
    """Nested summary for ranking: lists parsed, flags grouped. Lists may be stored as arrays or as text."""
    kinds = dict(df.dtypes)

    def strings(name: str, parse) -> Column:
        return F.col(name) if kinds[name].startswith("array") else parse(F.col(name))

    return df.select(
        "event_uuid",
        "quality_score",
        "importance",
        "value_rating",
        F.col("sentiment_summary").alias("sentiment"),
        strings("key_highlights", replies.json_strings).alias("highlights"),
        strings("concerns", replies.json_strings).alias("concerns"),
        strings("best_for", replies.csv_strings).alias("best_for"),
        "vibe",
        "uniqueness",
        F.struct(
            F.col("educational_value").alias("educational"),
            F.col("tourist_attraction").alias("tourist_spot"),
            F.col("bucket_list_worthy").alias("bucket_list"),
        ).alias("special_flags"),
    )
