"""Ingest whose cost follows the batch: duplicates by keyed state, events in a bucketed table.

Nothing stored is scanned. What has been seen is looked up in the state of a batch's own keys (see
``keyed_ingest_stream``), new and re-priced events rewrite only the buckets of their keys, and everything else is
appended as the batch's own folder. The events' manifest is written last and holds the batch's number: a batch that failed before it runs again as it did and overwrites its own
folders, one that fails after it is skipped.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fairground.functions import prices
from fairground.operators import normalize
from fairground.schemas import CONTENT, EVENTS, PERSON, PERSON_EVENT
from fairground.sources import buckets, sinks, versions
from fairground.streaming import keystate
from fairground.streaming.ingest import KEYS, REJECTED, content_rows, credit_edges, event_rows, fill

WRITER = "ingest"
DUPLICATE = "Duplicate event"


def stored_keys(spark: SparkSession, out: str) -> DataFrame:
    """Keys and times of the stored events, to start a new checkpoint from."""
    return buckets.read(spark, f"{out}/events").select(
        "title", "venue", F.col("date_raw").alias("date"), F.col("updated_at").alias("scraped_at")
    )


def store_marked(batch: DataFrame, batch_id: int, out: str, as_of: Column | None = None, writer: str = WRITER) -> None:
    """Write one batch of validated items that carry ``duplicate``."""
    spark, table = batch.sparkSession, f"{out}/events"
    if buckets.version(spark, table).writers.get(writer, -1) >= batch_id:
        batch.write.format("noop").mode("overwrite").save()  # the state must still see it
        return
    now = as_of if as_of is not None else F.current_timestamp()
    batch = batch.persist()
    try:
        good = normalize.accepted(batch)
        is_update = F.coalesce(F.col("is_update_job"), F.lit(False))
        fresh = good.where(~is_update & ~F.coalesce("duplicate", F.lit(False))).drop("duplicate")
        keyed = fresh.withColumn("uuid", F.coalesce("uuid", F.sha2(F.concat_ws("|", *KEYS), 256))).persist()
        priced = good.where(is_update).select(
            "uuid", F.col("price").try_cast("double").alias("price"), prices.ticket_prices("category_prices").alias("category_prices"),
            F.coalesce("scraped_at", now).alias("updated_at"),
        ).where("uuid IS NOT NULL")

        def merged(old: DataFrame) -> DataFrame:
            # an update job may carry the price of an event of the same batch
            rows = sinks.upsert(old, fill(event_rows(keyed, now), EVENTS))
            return sinks.patch(rows, priced, ["price", "category_prices", "updated_at"])

        touched = keyed.select("uuid").unionByName(priced.select("uuid"))
        versions.write_batch(fill(content_rows(keyed, now), CONTENT), f"{out}/content", batch_id)
        edges = sinks.check_roles(credit_edges(keyed)).persist()
        ok = edges.where("reject_reason IS NULL")
        versions.write_batch(fill(ok.select(F.col("person_uuid").alias("uuid"), "name").distinct(), PERSON), f"{out}/people", batch_id)
        versions.write_batch(fill(ok, PERSON_EVENT), f"{out}/person_event", batch_id)
        turned_down = edges.where("reject_reason IS NOT NULL").select(
            F.col("event_uuid").alias("uuid"), F.col("name").alias("title"), F.col("role").alias("source"), "reject_reason"
        )
        again = good.where(F.col("duplicate") & ~is_update).withColumn("reject_reason", F.lit(DUPLICATE))
        dropped = fill(normalize.rejected(batch), REJECTED).unionByName(fill(turned_down, REJECTED)).unionByName(fill(again, REJECTED))
        versions.write_batch(dropped, f"{out}/rejected", batch_id)
        buckets.change(spark, table, touched, merged, writer=writer, batch_id=batch_id)
        edges.unpersist()
        keyed.unpersist()
    finally:
        batch.unpersist()


def keyed_ingest_stream(
    items: DataFrame,
    out: str,
    checkpoint: str,
    default_source: str,
    ttl: timedelta | None = None,
    late: str = "0 seconds",
    as_of: Column | None = None,
    n_buckets: int = 256,
    available_now: bool = True,
) -> StreamingQuery:
    """Validate, mark duplicates by key, store. A new checkpoint over a table that exists starts from its keys.

    Without ``ttl`` no key is forgotten and ``late`` has no meaning: Spark's own state of distinct keys tells the new
    ones. A new checkpoint then keeps the stored keys in its folder and takes them as a second source. With ``ttl``,
    a Python call a key does.
    """
    spark = items.sparkSession
    if not buckets.exists(spark, f"{out}/events"):
        buckets.create(spark, f"{out}/events", EVENTS, buckets=n_buckets)
    checked = normalize.validate_items(items.withColumn("scraped_at", F.coalesce("scraped_at", F.current_timestamp())), default_source)
    plain = F.col("reject_reason").isNull() & ~F.coalesce(F.col("is_update_job"), F.lit(False))
    # a checkpoint numbers its batches from 0, so each one is a writer of its own
    writer = f"{WRITER}:{checkpoint}"
    if ttl is None:
        stored = _kept_keys(spark, out, checkpoint)
        rows = keystate.with_new_keys(checked.where(plain), stored)
        both = rows.unionByName(checked.where(~plain).withColumn("new_key", F.lit(None).cast("boolean")))

        def store(df: DataFrame, batch_id: int) -> None:
            keys = spark.read.schema(_KEYS).parquet(f"{checkpoint}/keys") if batch_id == 0 else None
            df = df.persist()  # a batch goes past the state once
            marked = keystate.mark_batch(df.where("new_key IS NOT NULL"), stored=keys)
            rest = df.where("new_key IS NULL").drop("new_key").withColumn("duplicate", F.lit(False))
            try:
                store_marked(marked.unionByName(rest), batch_id, out, as_of, writer)
            finally:
                df.unpersist()
    else:
        marked = keystate.mark_duplicates(checked.where(plain), ttl, late, stored=stored_keys(spark, out))
        both = marked.unionByName(checked.where(~plain).withColumn("duplicate", F.lit(False)))

        def store(df: DataFrame, batch_id: int) -> None:
            store_marked(df, batch_id, out, as_of, writer)

    query = both.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (query.trigger(availableNow=True) if available_now else query).start()


_KEYS = "title string, venue string, date string"


def _kept_keys(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """The keys stored before the checkpoint's first batch was planned, as a stream that brings them with that batch."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    planned = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets/0")
    if not planned.getFileSystem(conf).exists(planned):
        stored_keys(spark, out).select(*keystate.KEYS).distinct().write.mode("overwrite").parquet(f"{checkpoint}/keys")
    return spark.readStream.schema(_KEYS).parquet(f"{checkpoint}/keys")
