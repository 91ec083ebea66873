"""Joins, set operations and grouped lookups between the catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from fairground.functions import text


def with_summary(events: DataFrame, summary: DataFrame, how: str = "inner") -> DataFrame:
    """Event beside its summary."""
    return events.join(summary.withColumnRenamed("event_uuid", "uuid"), "uuid", how)


def with_rating(events: DataFrame, content: DataFrame, content_type: str = "platform_rating") -> DataFrame:
    """Every event, with its rating of one content type where there is one."""
    ratings = content.filter(F.col("content_type") == content_type)
    return events.join(ratings.select(F.col("event_uuid").alias("uuid"), "rating", "rating_count"), "uuid", "left")


def with_content(events: DataFrame, content: DataFrame, content_type: str | None = None) -> DataFrame:
    if content_type is not None:
        content = content.filter(F.col("content_type") == content_type)
    return events.join(content.withColumnRenamed("event_uuid", "uuid"), "uuid")


def with_people(events: DataFrame, people: DataFrame, edges: DataFrame) -> DataFrame:
    """(event, person name, role) rows."""
    named = edges.join(people.select(F.col("uuid").alias("person_uuid"), "name"), "person_uuid")
    return events.join(named.withColumnRenamed("event_uuid", "uuid"), "uuid").drop("person_uuid")


def collection_view(members: DataFrame, events: DataFrame, summary: DataFrame, category: str, n: int = 5) -> DataFrame:
    """First ``n`` events of a collection by rank, with their summaries where present."""
    chosen = members.filter(F.col("category") == category).select(F.col("event_uuid").alias("uuid"), "rank", "reason")
    # Only the members reach the summary join.
    rows = events.join(chosen, "uuid").join(
        summary.select(F.col("event_uuid").alias("uuid"), F.col("sentiment_summary").alias("summary")), "uuid", "left"
    )
    return rows.select("title", "venue", "date", "price", "reason", "rank", "summary").orderBy("rank").limit(n)


def backlog(events: DataFrame, summary: DataFrame) -> DataFrame:
    """Events that have no summary yet."""
    return events.join(summary.select(F.col("event_uuid").alias("uuid")), "uuid", "left_anti")


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "uuid") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def new_items(items: DataFrame, stored: DataFrame, keys: Sequence[str] = ("title", "venue", "date")) -> DataFrame:
    """Items whose trimmed key is not stored yet; a null key part equals ''.

    The stored keys are first cut down to those among the items: with few items that side is broadcast and the large
    stored table is only scanned.
    """
    names = [f"_{k}" for k in keys]
    keyed = items.withColumns({f"_{k}": _key(k) for k in keys})
    known = stored.select(*[_key(k).alias(f"_{k}") for k in keys]).join(keyed.select(*names).distinct(), names, "left_semi")
    return keyed.join(known, names, "left_anti").drop(*names)


def _key(name: str):
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def one_per(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key by ``order``; the rest of the key's rows drop out before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def with_venue_attributes(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Venue attributes joined by name."""
    attributes = venues.select(F.col("name").alias("venue"), "is_outdoors", "capacity", "vibe")
    return events.join(attributes, "venue", "left")


def edge_counts(**edges: DataFrame) -> DataFrame:
    """Rows per edge type over any number of edge tables."""
    tagged = None
    for name, df in edges.items():
        part = df.select(F.lit(name).alias("type"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def metadata_coverage(events: DataFrame, summary: DataFrame, fields: Sequence[str] = ("genre", "duration")) -> DataFrame:
    """Summarised events with any of the fields present: by null test alone, and by non-empty value."""
    joined = with_summary(events.select("uuid", *fields), summary.select("event_uuid"))
    any_set, any_filled = F.lit(False), F.lit(False)
    for f in fields:
        any_set = any_set | F.col(f).isNotNull()
        any_filled = any_filled | ~text.blank(F.col(f))
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(any_set).alias("not_null"), F.count_if(any_filled).alias("non_empty")
    )


def average_rating(content: DataFrame, content_type: str = "user_review") -> DataFrame:
    """Mean review rating per event over ratings above zero; null for events with reviews but no rating."""
    rows = content.filter(F.col("content_type") == content_type)
    return rows.groupBy("event_uuid").agg(F.avg(F.when(F.col("rating") > 0, F.col("rating"))).alias("avg_rating"))


def top_rated(content: DataFrame, min_reviews: int = 3, n: int = 10, content_type: str = "user_review") -> DataFrame:
    rated = content.filter((F.col("content_type") == content_type) & (F.col("rating") > 0))
    means = rated.groupBy("event_uuid").agg(
        F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("review_count")
    )
    return means.filter(F.col("review_count") >= min_reviews).orderBy(F.desc("avg_rating"), "event_uuid").limit(n)


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def exact_duplicates(df: DataFrame, keys: Sequence[str] = ("title", "venue", "date")) -> DataFrame:
    """(digest, n, keys): each combination of ``keys`` held by more than one row, and how many hold it.

    Rows are counted by digest, so only 32 bytes of each are shuffled; the keys themselves follow for the few that
    repeat.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(k) for k in keys])), 256).alias("digest")
    groups = df.select(digest).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    named = df.select(digest, *keys).join(groups, "digest")
    return named.groupBy("digest", "n").agg(*[F.first(k).alias(k) for k in keys])


def latest_per(df: DataFrame, by: str, order: str, n: int, tie: str) -> DataFrame:
    """Latest ``n`` rows per group. The rank limit is applied map-side before the shuffle."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order), F.asc(tie)))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def distinct_venues(df: DataFrame) -> DataFrame:
    return df.select("venue").filter(~text.blank(F.col("venue"))).distinct()
