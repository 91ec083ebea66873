"""Enrichment: context text, pluggable inference, decoding and outcome accounting.

The inference service itself is the caller's: a function from an iterator of pandas batches to an iterator of pandas
batches, run with ``mapInPandas`` between native stages, so its parallelism is the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fairground.functions import replies, text
from fairground.operators import filters, relations

Infer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def review_text(content: DataFrame, order: str, n: int = 5, size: int = 500) -> DataFrame:
    """First ``n`` reviews per event as one bullet text, each cut to ``size`` characters for the prompt."""
    ranked = content.withColumn("_i", F.row_number().over(W.partitionBy("event_uuid").orderBy(order)))
    kept = ranked.filter(F.col("_i") <= n)
    bullet = F.concat(F.lit("- "), text.truncate(F.col("text"), size))
    bullets = F.transform(F.array_sort(F.collect_list(F.struct("_i", bullet.alias("b")))), lambda s: s["b"])
    return kept.groupBy("event_uuid").agg(F.array_join(bullets, "\n").alias("reviews"))


def people_text(named: DataFrame) -> DataFrame:
    """'ROLE: name, name' lines per event from (event_uuid, name, role), roles and names in order.

    Names are de-duplicated per (event, role) before they are gathered, so the text holds each person once.
    """
    unique = named.select("event_uuid", "role", "name").distinct()
    roles = unique.groupBy("event_uuid", "role").agg(
        F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names")
    )
    lines = F.sort_array(F.collect_list(F.concat_ws(": ", "role", "names")))
    return roles.groupBy("event_uuid").agg(F.array_join(lines, "\n").alias("people"))


def context_text(df: DataFrame, size: int | None = None) -> Column:
    """Prompt context: every field with its default, description (cut to ``size`` characters when given), people,
    reviews."""

    def field(label: str, name: str, default: str) -> Column:
        return F.concat(F.lit(f"{label}: "), text.or_default(F.col(name).cast("string"), default))

    described = F.when(text.blank(F.col("description")), F.lit("No description")).otherwise(
        F.col("description") if size is None else text.truncate(F.col("description"), size)
    )
    fields = [
        field("Title", "title", "Unknown"),
        field("Category", "category", "Uncategorized"),
        field("Genre", "genre", "Unknown"),
        field("Duration", "duration", "Unknown"),
        F.concat(F.lit("Description: "), described),
        field("Venue", "venue", "Unknown venue"),
        field("City", "city", "Unknown city"),
        field("Price", "price", "0"),
        F.coalesce(F.concat(F.lit("KEY PEOPLE (Verified):\n"), F.col("people")), F.lit("")),
        F.coalesce(F.concat(F.lit("TOP USER REVIEWS:\n"), F.col("reviews")), F.lit("No reviews available.")),
    ]
    return F.concat_ws("\n", *fields)


def add_context(events: DataFrame, reviews: DataFrame, people: DataFrame, size: int | None = None) -> DataFrame:
    """Events with their ``context`` text; absent optional columns count as missing."""
    for name in ("genre", "duration", "city"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    joined = events.join(reviews.withColumnRenamed("event_uuid", "uuid"), "uuid", "left").join(
        people.withColumnRenamed("event_uuid", "uuid"), "uuid", "left"
    )
    return joined.withColumn("context", context_text(joined, size))


def run_inference(df: DataFrame, infer: Infer, columns: str, partitions: int | None = None) -> DataFrame:
    """Apply the caller's model; ``partitions`` bounds how many calls run at once."""
    return (df.repartition(partitions) if partitions else df).mapInPandas(infer, columns)


SUMMARY_REPLY = """struct<refined_category: string, quality_score: double, importance: string, value_rating: string,
sentiment_summary: string, key_highlights: array<string>, concerns: array<string>, best_for: array<string>,
vibe: string, uniqueness: string, educational_value: boolean, tourist_attraction: boolean,
bucket_list_worthy: boolean>"""


def select_for_enrichment(
    events: DataFrame, summary: DataFrame, content: DataFrame, people: DataFrame,
    overwrite: bool = False, force: bool = False,
) -> DataFrame:
    """All events with ``state``: 'skipped' (has a summary), 'skipped_low_quality', or null for those to process."""
    done = summary.select(F.col("event_uuid").alias("uuid")).distinct().withColumn("_done", F.lit(not overwrite))
    marked = filters.mark_enrichable(events.join(done, "uuid", "left"), content, people, force)
    state = F.when(F.coalesce("_done", F.lit(False)), "skipped").when(~F.col("eligible"), "skipped_low_quality")
    return marked.withColumn("state", state).drop("_done", "eligible")


def enrich(selected: DataFrame, infer: Infer, partitions: int | None = None) -> DataFrame:
    """Run the model over the selected events: (uuid, category, reply struct, state) for every event.

    ``infer`` receives (uuid, context) batches and yields (uuid, reply) with the raw JSON text. A reply that does
    not parse makes the event 'failed'.
    """
    todo = selected.filter(F.col("state").isNull())
    raw = run_inference(todo.select("uuid", "context"), infer, _types(selected, "uuid") + ", reply string", partitions)
    decoded = raw.withColumn("reply", replies.decode_reply(F.col("reply"), SUMMARY_REPLY, []))
    joined = selected.join(decoded, "uuid", "left")
    outcome = F.coalesce("state", F.when(F.col("reply").isNotNull(), "success").otherwise("failed"))
    category = replies.refine_category(F.col("category"), F.col("reply.refined_category"))
    return joined.select("uuid", category.alias("category"), "reply", outcome.alias("state"))


def _types(df: DataFrame, *names: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def outcomes(df: DataFrame) -> DataFrame:
    """Events per outcome."""
    return df.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def summary_rows(enriched: DataFrame) -> DataFrame:
    """Successful replies as summary rows, absent flags false and absent lists empty."""
    r = "reply."
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(r + c, empty).alias(c) for c in ("key_highlights", "concerns", "best_for")]
    flags = [F.coalesce(r + c, F.lit(False)).alias(c) for c in ("educational_value", "tourist_attraction", "bucket_list_worthy")]
    plain = [F.col(r + c) for c in ("quality_score", "importance", "value_rating", "sentiment_summary", "vibe", "uniqueness")]
    done = enriched.filter(F.col("state") == "success")
    return done.select(F.col("uuid").alias("event_uuid"), *plain, *lists, *flags)


def extract_people(events: DataFrame, infer: Infer, partitions: int | None = None) -> DataFrame:
    """(event_uuid, name, role) from the caller's model over long enough descriptions; unknown roles are kept here
    and turned down by ``sinks.upsert_edges``."""
    todo = filters.extractable(events).select("uuid", "title", "description")
    raw = run_inference(todo, infer, _types(events, "uuid") + ", reply string", partitions)
    found = raw.select(F.col("uuid").alias("event_uuid"), F.explode(replies.decode_people(F.col("reply"))).alias("p"))
    return found.select("event_uuid", "p.name", "p.role").distinct()


def enrich_venues(events: DataFrame, venues: DataFrame, infer: Infer, city: str = "İstanbul") -> DataFrame:
    """Attributes of venues not known yet; absent attributes get their defaults."""
    names = relations.distinct_venues(events).select(F.col("venue").alias("name"))
    new = names.join(venues.select("name"), "name", "left_anti").withColumn("city", F.lit(city))
    answered = run_inference(new, infer, "name string, is_outdoors boolean, vibe string, capacity int")
    joined = new.join(answered, "name", "left")
    return joined.select(F.sha2("name", 256).alias("uuid"), "name", "city", *venue_defaults())


def venue_defaults() -> list[Column]:
    return [
        F.coalesce("is_outdoors", F.lit(False)).alias("is_outdoors"),
        F.coalesce("vibe", F.lit("Unknown")).alias("vibe"),
        F.coalesce("capacity", F.lit(0)).alias("capacity"),
    ]


def embed(events: DataFrame, infer: Infer, partitions: int | None = None) -> DataFrame:
    """(event_uuid, embedding) of 'title. venue. category. description' from the caller's model."""
    parts = [F.col(c) for c in ("title", "venue", "category", "description")]
    todo = events.select(F.col("uuid").alias("event_uuid"), text.embedding_text(*parts).alias("text"))
    kinds = dict(events.dtypes)
    return run_inference(todo, infer, f"event_uuid {kinds['uuid']}, embedding array<float>", partitions)


def summary_audit(summary: DataFrame) -> DataFrame:
    """Count, score range and boilerplate share of the summaries; one row."""
    poor = F.count_if(text.is_boilerplate(F.col("sentiment_summary")))
    return summary.agg(
        F.count(F.lit(1)).alias("total"), F.avg("quality_score").alias("avg_score"),
        F.min("quality_score").alias("min_score"), F.max("quality_score").alias("max_score"),
        poor.alias("n_boilerplate"), F.try_divide(poor * 100.0, F.count(F.lit(1))).alias("pct_boilerplate"),
    )


def rating_distribution(summary: DataFrame) -> DataFrame:
    """Importance and value ratings counted in one pass, null as 'Unknown'."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown")).alias("value"))
        for c in ("importance", "value_rating")
    ]))
    return summary.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def priced_share(events: DataFrame, summary: DataFrame, column: str = "category_prices") -> DataFrame:
    """Summarised events whose category prices hold more than five characters of text."""
    joined = events.select("uuid", column).join(summary.select(F.col("event_uuid").alias("uuid")), "uuid")
    n = F.count_if(F.length(F.col(column)) > 5)
    return joined.agg(F.count(F.lit(1)).alias("total"), n.alias("n_priced"),
                      F.try_divide(n * 100.0, F.count(F.lit(1))).alias("pct_priced"))


def backlog_report(events: DataFrame, summary: DataFrame, cloud: float = 0.2, local: float = 1.5) -> DataFrame:
    """Pending events split into actionable and likely skipped, progress, and minutes at seconds per event."""
    done = summary.select(F.col("event_uuid").alias("uuid")).distinct().withColumn("_done", F.lit(True))
    marked = events.select("uuid", "description").join(done, "uuid", "left")
    open_, ready = F.col("_done").isNull(), filters.has_text(F.col("description"))
    totals = marked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("pending"),
        F.count_if(open_ & ready).alias("actionable"), F.count_if(open_ & ~ready).alias("likely_skipped"),
    )
    work = F.when(F.col("actionable") > 0, F.col("actionable")).otherwise(F.col("likely_skipped"))
    return totals.select(
        "*",
        F.coalesce(F.try_divide((F.col("total") - F.col("pending")) * 100.0, F.col("total")), F.lit(0.0)).alias("progress"),
        (work * cloud / 60).alias("cloud_minutes"),
        (work * local / 60).alias("local_minutes"),
    )
