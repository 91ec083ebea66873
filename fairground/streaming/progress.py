"""Progress of a running ingest as windowed counts, and price updates as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fairground.functions import prices
from fairground.sources import versions
from fairground.streaming import counters


def windowed_counts(df: DataFrame, ts: str = "ts", width: str = "1 minute", watermark: str = "10 minutes",
                    by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per tumbling window (and group), for streams and tables alike. Rows later than the watermark are left
    out of a stream; a table has none."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        rows = rows.withWatermark("_ts", watermark)
    grouped = rows.groupBy(F.window("_ts", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), *by, "n")


def progress_stream(df: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Windowed counts for a progress page: each trigger adds the windows that changed as one batch of a log.

    Windows older than the watermark are final and leave the state, so it is bounded. Nothing is rewritten under a
    reader; a replayed batch replaces its own copy. Read with ``read_progress``.
    """
    writer = windowed_counts(df, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda counts, i: versions.write_batch(counts, out, i)).trigger(availableNow=True).start()


def read_progress(spark: SparkSession, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The last count of every window (and group)."""
    return spark.read.parquet(out).groupBy("window_start", *by).agg(F.max_by("n", "batch").alias("n"))


def _priced(stamp: Column) -> tuple[list[Column], list[Column]]:
    """What a price batch is grouped to, and selected from that. A stream makes it once: in small steps, calling Spark for
    every part of an expression takes longer than the rows."""
    return [F.max_by(F.struct("price", "category_prices"), "scraped_at").alias("u")], [
        F.col("uuid"), prices.valid_price(F.col("u.price")).alias("price"),
        prices.ticket_prices(F.col("u.category_prices")).alias("category_prices"), stamp.alias("updated_at"),
    ]


def reprice_batch(batch: DataFrame, batch_id: int, out: str, stamp: Column, priced: tuple[list[Column], list[Column]] | None = None) -> None:
    """Price results (uuid, price, category_prices) laid over the stored events, which are not read for it: a batch costs
    its own rows, whatever is stored. Which price is the last depends on time alone; a replay writes the same rows."""
    last, columns = priced or _priced(stamp)
    versions.write_patches(batch.groupBy("uuid").agg(*last).select(*columns), f"{out}/events", batch_id)


def reprice_stream(found: DataFrame, out: str, checkpoint: str, stamp: Column, every: str | None = None) -> StreamingQuery:
    """Landed price results applied batch by batch: all that has landed, or a step ``every`` so often. The rows of a
    step are bounded by the source (``stream_paged``), which makes the rate."""
    priced = _priced(stamp)
    writer = found.writeStream.foreachBatch(lambda batch, i: reprice_batch(batch, i, out, stamp, priced))
    if every:
        return counters.start_steps(found.sparkSession, writer.trigger(processingTime=every), checkpoint)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
