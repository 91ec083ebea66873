"""Continuous ingest of crawled items into versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fairground.functions import dates, prices, text
from fairground.operators import normalize
from fairground.schemas import CONTENT, DEFAULT_CATEGORY, EVENTS, ITEM, PERSON, PERSON_EVENT
from fairground.session import shuffles_dropped
from fairground.sources import sinks, versions

KEYS = ("title", "venue", "date")
REJECTED = "uuid string, title string, source string, reject_reason string"


def read_items(spark: SparkSession, path: str, files_per_trigger: int | None = None, kind: str = "json") -> DataFrame:
    """Landed item files as a stream, read with the declared schema."""
    reader = spark.readStream.schema(ITEM).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def item_keys(df: DataFrame) -> DataFrame:
    """Trim title, venue and date; null venue and date become ''."""
    return df.withColumns({k: F.trim(F.coalesce(F.col(k), F.lit(""))) for k in KEYS})


def session_dedup(stream: DataFrame, watermark: str = "30 days", ts: str = "scraped_at") -> DataFrame:
    """First item per (title, venue, date); update jobs pass through.

    In a stream, keys are forgotten once they are ``watermark`` older than the newest item, which bounds the state. A
    table needs no state.
    """
    is_update = F.coalesce(F.col("is_update_job"), F.lit(False))
    fresh = item_keys(stream.filter(~is_update))
    if stream.isStreaming:
        fresh = fresh.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(KEYS))
    else:
        fresh = fresh.dropDuplicates(list(KEYS))
    return fresh.unionByName(stream.filter(is_update))


def new_in_batch(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items of one batch whose key is neither stored nor earlier in the batch.

    Items and stored keys meet in one aggregate, so a whole item is shuffled once, and of a key one item a task. Items of
    the same time and uuid go by their other columns: a batch that is read twice has the same new items.
    """
    order = ["scraped_at", "uuid", *[c for c in items.columns if c not in (*KEYS, "scraped_at", "uuid")]]
    kinds = {f.name: f.dataType for f in items.schema}
    arrived = item_keys(items).select(*KEYS, F.struct(F.lit(True).alias("arrived"), *order).alias("r"))
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in order]
    known = item_keys(stored.select("title", "venue", F.col("date_raw").alias("date"))).select(
        *KEYS, F.struct(F.lit(False).alias("arrived"), *nothing).alias("r")
    )
    # rows are sorted by the hash: the texts are compared where it is the same
    first = arrived.unionByName(known).groupBy(F.hash(*KEYS), *KEYS).agg(F.min("r").alias("r")).where("r.arrived")
    return first.select(*KEYS, *[F.col(f"r.{c}") for c in items.columns if c not in KEYS])


def event_rows(items: DataFrame, as_of: Column) -> DataFrame:
    """Items as stored events: typed date beside the raw text, ticket JSON parsed, key generated when absent."""
    key = F.coalesce("uuid", F.sha2(F.concat_ws("|", *KEYS), 256))
    ts = dates.catalogue_timestamp(F.col("date"), as_of)
    stamp = F.coalesce("scraped_at", as_of)
    return items.select(
        key.alias("uuid"), "title", "description", F.col("date").alias("date_raw"), ts.cast("date").alias("event_date"),
        ts.alias("event_ts"), "venue", "city", F.col("price").try_cast("double").alias("price"), "price_range",
        prices.ticket_prices("category_prices").alias("category_prices"), "url", "image_url",
        text.or_default(F.col("category"), DEFAULT_CATEGORY).alias("category"), "genre", "duration", "source",
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def content_rows(items: DataFrame, as_of: Column) -> DataFrame:
    """Platform rating and reviews of the items as content rows."""
    stamp = F.coalesce("scraped_at", as_of)
    rated = items.filter(F.col("rating").isNotNull() & F.col("rating_count").isNotNull()).select(
        F.col("uuid").alias("event_uuid"), F.lit("platform_rating").alias("content_type"), F.lit(None).cast("string").alias("text"),
        "rating", "rating_count", F.coalesce("source", F.lit("platform")).alias("author"), stamp.alias("updated_at"),
    )
    said = items.select("uuid", stamp.alias("updated_at"), F.explode("reviews").alias("r")).select(
        F.col("uuid").alias("event_uuid"), F.coalesce("r.content_type", F.lit("user_review")).alias("content_type"), "r.text",
        "r.rating", F.lit(None).cast("int").alias("rating_count"), F.coalesce("r.author", F.lit("Anonymous")).alias("author"),
        "updated_at",
    )
    rows = rated.unionByName(said)
    digest = F.sha2(F.concat_ws("|", "event_uuid", "content_type", "author", "text"), 256)
    return rows.withColumn("uuid", digest).withColumn("created_at", F.col("updated_at"))


def credit_edges(items: DataFrame) -> DataFrame:
    """(name, person_uuid, event_uuid, role) of the extracted entities; the person key is a digest of the name."""
    people = items.select(F.col("uuid").alias("event_uuid"), F.inline("extracted_entities"))
    named = people.filter(~text.blank(F.col("name")) & ~text.blank(F.col("role")))
    return named.withColumn("person_uuid", F.sha2("name", 256)).distinct()


def fill(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` in order, absent ones null."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted
    ])


def _carries() -> Column:
    """Whether an item brings content or people."""
    listed = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("reviews", "extracted_entities")]
    return (F.col("rating").isNotNull() & F.col("rating_count").isNotNull()) | listed[0] | listed[1]


def _new_items(items: DataFrame, batch_id: int, out: str, turn: versions.Turn = None, only: DataFrame | None = None) -> DataFrame:
    """The new items of a batch (of the keys in ``only``, of a turn's share) with their uuid."""
    # Any version of a row carries its key, so the log is scanned for three columns and not resolved.
    log = versions.read_log(items.sparkSession, f"{out}/events", EVENTS, batch_id)
    stored = item_keys(log.select("title", "venue", F.col("date_raw").alias("date")))
    sides = [versions.share(df, KEYS, turn) for df in (item_keys(items), stored)]
    if only is not None:
        sides = [df.join(only, list(KEYS), "left_semi").select(*df.columns) for df in sides]
    fresh = new_in_batch(sides[0], sides[1].withColumnRenamed("date", "date_raw"))
    return fresh.withColumn("uuid", F.coalesce("uuid", F.sha2(F.concat_ws("|", *KEYS), 256)))


def store_batch(batch: DataFrame, batch_id: int, out: str, as_of: Column | None = None) -> None:
    """Write one validated batch. The batch's own earlier copy doesn't count as stored, so a replay writes the same rows.

    A batch may hold an event and its price update; the update then applies to the event as it is stored. Without
    ``as_of``, items should carry ``scraped_at`` (``ingest_stream`` sees to it): the clock is another one in a replay.

    The batch is read once per table that gets its rows and kept nowhere, as a copy may be larger than what it came
    from; one that isn't the same each time it is read must be persisted by the caller.
    """
    spark = batch.sparkSession
    now = as_of if as_of is not None else F.current_timestamp()
    good = normalize.accepted(batch)
    is_update = F.coalesce(F.col("is_update_job"), F.lit(False))
    items = good.filter(~is_update)
    repriced = good.filter(is_update).groupBy("uuid").agg(
        F.max_by(F.struct("price", "category_prices", "scraped_at"), "scraped_at").alias("u")
    ).select(
        "uuid", F.col("u.price").try_cast("double").alias("price"),
        prices.ticket_prices(F.col("u.category_prices")).alias("category_prices"),
        F.coalesce("u.scraped_at", now).alias("updated_at"),
    )
    with shuffles_dropped(spark):
        n_items, n_updates = good.agg(F.count_if(~is_update), F.count_if(is_update)).first()
        n_stored = versions.read_log(spark, f"{out}/events", EVENTS, batch_id).count() if n_updates else 0

    def events(turn: versions.Turn) -> DataFrame:
        due = versions.share(repriced, ["uuid"], turn)
        touched = versions.current(spark, f"{out}/events", EVENTS, "uuid", batch_id, only=due, turn=turn)
        rows = fill(event_rows(_new_items(items, batch_id, out, turn), now), EVENTS).unionByName(fill(touched, EVENTS))
        return sinks.patch(rows, repriced, ["price", "category_prices", "updated_at"])

    versions.write_in_turns(spark, events, max(n_items, n_stored), f"{out}/events", batch_id)

    # what goes beside the events is sought among the keys whose items bring any
    keys = item_keys(items.where(_carries())).select(*KEYS).distinct()
    keyed = _new_items(items, batch_id, out, only=keys).where(_carries()).persist()
    edges = sinks.check_roles(credit_edges(keyed)).persist()
    try:
        versions.write_batch(fill(content_rows(keyed, now), CONTENT), f"{out}/content", batch_id)
        ok = edges.filter(F.col("reject_reason").isNull())
        people = ok.select(F.col("person_uuid").alias("uuid"), "name").distinct()
        versions.write_batch(fill(people, PERSON), f"{out}/people", batch_id)
        versions.write_batch(fill(ok, PERSON_EVENT), f"{out}/person_event", batch_id)
        turned_down = edges.filter(F.col("reject_reason").isNotNull()).select(
            F.col("event_uuid").alias("uuid"), F.col("name").alias("title"), F.col("role").alias("source"), "reject_reason"
        )
        dropped = fill(normalize.rejected(batch), REJECTED).unionByName(fill(turned_down, REJECTED))
        versions.write_batch(dropped, f"{out}/rejected", batch_id)
    finally:
        edges.unpersist()
        keyed.unpersist()


def ingest_stream(
    items: DataFrame,
    out: str,
    checkpoint: str,
    default_source: str,
    watermark: str = "30 days",
    stateful: bool = False,
    as_of: Column | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Validate, drop duplicates, store: one query over the landed items.

    Duplicates are found against the stored table and inside the batch, which needs no streaming state and forgets
    nothing. ``stateful`` adds the in-stream de-duplication (bounded by ``watermark``) in front of it.
    Accepted and dropped items are counted in the query's progress under 'ingest'.
    """
    # a stream's clock is that of the batch's first run, so a replay stamps the same time
    stamped = items.withColumn("scraped_at", F.coalesce("scraped_at", F.current_timestamp()))
    checked = normalize.validate_items(stamped, default_source)
    if stateful:
        good = checked.filter(F.col("reject_reason").isNull())
        checked = session_dedup(good, watermark).unionByName(checked.filter(F.col("reject_reason").isNotNull()))
    counted = checked.observe(
        "ingest",
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("dropped"),
    )

    def store(df: DataFrame, batch_id: int) -> None:
        df = df.persist()  # a batch goes past the state and the counters once
        try:
            store_batch(df, batch_id, out, as_of)
        finally:
            df.unpersist()

    writer = counted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
