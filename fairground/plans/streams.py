"""Ingest steps and progress over the supplied tables: the batch form has SQL, the streaming form must give the same."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import functions as F

from fairground.operators import normalize
from fairground.plans.registry import query
from fairground.schemas import EVENTS
from fairground.session import scratch_folder
from fairground.sources import buckets, paged, pages, versions
from fairground.sources.tables import read_table
from fairground.streaming import counters, ingest, keyed_ingest, keystate, progress


ITEM_STEP, PRICE_STEP, PAGE_STEP = 50_000, 10_000, 1_000  # rows a trigger takes


def as_of():
    return F.lit("2026-01-01").cast("timestamp")


def _shown(name):
    """A value as ``format_string`` shows it, in a fraction of the time."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def items(df):
    """Line items as landed crawl items: part, supplier and month make the key, so most keys repeat."""
    return df.select(
        F.concat_ws(
            "-", *[_shown(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.coalesce(F.date_format("l_shipdate", "yyMMdd"), F.lit("null")),
        ).alias("uuid"),
        F.when(F.col("l_returnflag") != "A", F.concat(F.lit("Part "), _shown("l_partkey"))).alias("title"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" supplier "), _shown("l_suppkey"), F.lit(" "))).alias("venue"),
        F.date_format("l_shipdate", "yyyy-MM").alias("date"),
        (F.col("l_extendedprice") * 2).cast("string").alias("price"),
        F.lit(None).cast("string").alias("source"),
        F.lit(False).alias("is_update_job"),
        F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
    )


_KEYED = """
WITH i AS (SELECT CASE WHEN l_returnflag <> 'A' THEN 'Part ' || l_partkey END AS title,
                  CASE WHEN l_linestatus = 'O' THEN 'supplier ' || l_suppkey ELSE '' END AS venue,
                  strftime(l_shipdate, '%Y-%m') AS date, l_extendedprice * 2 AS price FROM lineitem)
"""


@query("x02_first_per_key", _KEYED + "SELECT DISTINCT title, venue, date FROM i WHERE title IS NOT NULL")
def x02(spark, sf):
    checked = normalize.validate_items(items(read_table(spark, sf, "lineitem")), "crawl")
    return ingest.session_dedup(normalize.accepted(checked)).select("title", "venue", "date")


@query("x03_not_stored_yet", _KEYED + """
SELECT DISTINCT title, venue, date FROM i WHERE title IS NOT NULL
EXCEPT SELECT title, venue, date FROM i WHERE title IS NOT NULL AND venue = ''""")
def x03(spark, sf):
    good = normalize.accepted(normalize.validate_items(items(read_table(spark, sf, "lineitem")), "crawl"))
    stored = good.filter(F.col("venue").isNull()).withColumnRenamed("date", "date_raw")
    return ingest.new_in_batch(good, stored).select("title", "venue", "date")


@query("x06_item_counters", _KEYED + """
SELECT count(*) AS seen, count(*) FILTER (title IS NULL) AS dropped,
       count(*) FILTER (title IS NOT NULL AND price > 100000) AS unpriced FROM i""")
def x06(spark, sf):
    checked = normalize.validate_items(items(read_table(spark, sf, "lineitem")), "crawl")
    return checked.agg(*counters.item_counts())


@query("x06_trigger_counters", _KEYED + f"""
SELECT count(*) AS seen, count(*) FILTER (title IS NULL) AS dropped,
       count(*) FILTER (title IS NOT NULL AND price > 100000) AS unpriced, true AS bounded,
       ceil(count(*) / {ITEM_STEP})::BIGINT AS triggers FROM i""")
def x06_triggers(spark, sf):
    """The same counters, observed while landed items are validated in bounded steps and those dropped are stored."""
    out = scratch_folder(spark, "counters")
    landed = items(read_table(spark, sf, "lineitem"))
    paged.land(landed, f"{out}/in/batch=0", ITEM_STEP)
    stream = paged.stream_paged(spark, f"{out}/in", ITEM_STEP, landed.schema)
    checked = normalize.validate_items(stream, "crawl").observe("items", *counters.item_counts())
    listener = counters.TriggerCounters(spark, f"{out}/counters", "items")
    spark.streams.addListener(listener)
    try:
        writer = checked.where("reject_reason IS NOT NULL").writeStream.format("parquet").option("path", f"{out}/dropped")
        run = counters.start_steps(spark, writer.trigger(processingTime="0 seconds"), f"{out}/checkpoint")
        counters.run_steps(run)
        listener.wait(run)
    finally:
        spark.streams.removeListener(listener)
    dropped = spark.read.schema(checked.schema).parquet(f"{out}/dropped").agg(F.count(F.lit(1))).scalar()
    return counters.read_counters(spark, f"{out}/counters").agg(
        F.sum("seen").alias("seen"), F.when(F.sum("dropped") == dropped, F.sum("dropped")).alias("dropped"),
        F.sum("unpriced").alias("unpriced"), (F.max("seen") <= ITEM_STEP).alias("bounded"), F.count(F.lit(1)).alias("triggers"),
    )


_WINDOWS = """
SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"""


@query("x05_progress_windows", _WINDOWS)
def x05(spark, sf):
    counts = progress.windowed_counts(read_table(spark, sf, "events"), width="1 hour", by=("event_type",))
    return counts.withColumn("window_start", F.col("window_start").cast("long"))


@query("x05_progress_stream", _WINDOWS)
def x05_stream(spark, sf):
    """The same counts from a stream over the table's file, run until its input is exhausted."""
    stream = spark.readStream.schema(read_table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    out = scratch_folder(spark, "progress")
    progress.progress_stream(stream, f"{out}/table", f"{out}/checkpoint", width="1 hour", by=("event_type",)).awaitTermination()
    counts = progress.read_progress(spark, f"{out}/table", ("event_type",))
    return counts.withColumn("window_start", F.col("window_start").cast("long"))


# Stored items, and re-pricing jobs for every first line: half the list price, a year later.

_STORED = """
WITH f AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%y%m%d') AS uuid, l_linenumber, l_quantity, l_extendedprice, l_linestatus,
         'Part ' || l_partkey AS title, CASE WHEN l_linestatus = 'O' THEN 'supplier ' || l_suppkey ELSE '' END AS venue,
         strftime(l_shipdate, '%Y-%m') AS date, l_shipdate,
         CASE WHEN l_extendedprice * 2 <= 100000 THEN l_extendedprice * 2 END AS price
  FROM lineitem WHERE l_returnflag <> 'A'),
s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY title, venue, date ORDER BY l_shipdate, uuid) = 1)
"""


def _landed(spark, sf):
    """(items, update jobs) with all columns of a landed item."""
    lines = read_table(spark, sf, "lineitem")
    jobs = items(lines.where("l_linenumber = 1")).withColumns({
        "price": (F.col("price").cast("double") / 4).cast("string"), "is_update_job": F.lit(True),
        "scraped_at": F.col("scraped_at") + F.expr("interval 1 year"),
    })
    return [normalize.validate_items(ingest.fill(x, ingest.ITEM), "crawl") for x in (items(lines), jobs)]


def _stored(spark, out):
    rows = versions.current(spark, f"{out}/events", EVENTS, "uuid", columns=["uuid", "title", "venue", "date_raw", "price"])
    return rows.select("uuid", "title", "venue", F.col("date_raw").alias("date"), "price")


@query("x01_ingest", _STORED + """
SELECT uuid, title, venue, date, CASE WHEN l_linenumber = 1 THEN l_extendedprice / 2 ELSE price END AS price FROM s""")
def x01(spark, sf):
    """Two batches; the second brings new events, and updates both of them and of the first batch's."""
    landed, jobs = _landed(spark, sf)
    out = scratch_folder(spark, "ingest")
    ingest.store_batch(landed.where("venue IS NULL"), 0, out, as_of())
    ingest.store_batch(landed.where("venue IS NOT NULL").unionByName(jobs), 1, out, as_of())
    return _stored(spark, out)


@query("x04_replay", _STORED + "SELECT uuid, title, venue, date, price FROM s")
def x04(spark, sf):
    """A batch is replayed, the log is folded, and all items arrive once more: nothing is stored twice."""
    landed, _ = _landed(spark, sf)
    out = scratch_folder(spark, "replay")
    for batch in (0, 1, 1):
        ingest.store_batch(landed.where("venue IS NULL") if batch == 0 else landed, batch, f"{out}/log", as_of())
    versions.compact(spark, f"{out}/log/events", f"{out}/folded/events", EVENTS, "uuid")
    ingest.store_batch(landed, 2, f"{out}/folded", as_of())
    log = versions.read_log(spark, f"{out}/folded/events", EVENTS)
    return log.select("uuid", "title", "venue", F.col("date_raw").alias("date"), "price")


@query("x07_reprice", _STORED + """
SELECT uuid, title, venue, date, CASE WHEN l_linenumber = 1 AND l_quantity > 25 THEN l_extendedprice / 2
       WHEN l_linenumber = 1 THEN CASE WHEN l_extendedprice <= 100000 THEN l_extendedprice END ELSE price END AS price FROM s""")
def x07(spark, sf):
    """Prices found for first lines, replayed once, and later updates of some of them by the ingest, which must win."""
    landed, jobs = _landed(spark, sf)
    out = scratch_folder(spark, "reprice")
    ingest.store_batch(landed, 0, out, as_of())
    found = items(read_table(spark, sf, "lineitem").where("l_linenumber = 1")).select(
        "uuid", (F.col("price").cast("double") / 2).cast("string").alias("price"),
        F.lit(None).cast("string").alias("category_prices"), "scraped_at",
    )
    for _ in range(2):
        progress.reprice_batch(found, 0, out, F.lit("2050-06-01").cast("timestamp"))
    large = items(read_table(spark, sf, "lineitem").where("l_quantity > 25")).select("uuid")
    later = jobs.join(large, "uuid", "left_semi").withColumn("scraped_at", F.lit("2051-01-01").cast("timestamp"))
    ingest.store_batch(later.select(*jobs.columns), 1, out, as_of())
    return _stored(spark, out)


@query("x07_bounded_reprice", _STORED + """
SELECT uuid, title, venue, date, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_extendedprice <= 100000 THEN l_extendedprice END
       ELSE price END AS price FROM s""")
def x07_bounded(spark, sf):
    """Prices found for first lines, applied by a stream at a bounded rate."""
    landed, _ = _landed(spark, sf)
    out = scratch_folder(spark, "bounded")
    ingest.store_batch(landed, 0, out, as_of())
    found = items(read_table(spark, sf, "lineitem").where("l_linenumber = 1")).select(
        "uuid", (F.col("price").cast("double") / 2).cast("string").alias("price"),
        F.lit(None).cast("string").alias("category_prices"), "scraped_at",
    )
    paged.land(found, f"{out}/in/batch=0", PRICE_STEP)
    steps = paged.stream_paged(spark, f"{out}/in", PRICE_STEP, found.schema)
    counters.run_steps(progress.reprice_stream(steps, out, f"{out}/checkpoint", F.lit("2050-06-01").cast("timestamp"), "0 seconds"))
    return _stored(spark, out)


_TITLES = """SELECT page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<li><a href=')) AS n_links FROM pages"""


def _archive(spark, sf, name):
    """The pages as two landings of an archive, written one by one."""
    table, out = read_table(spark, sf, "pages"), scratch_folder(spark, name)
    for i, part in enumerate(["page_id % 2 = 0", "page_id % 2 = 1 OR page_id IS NULL"]):
        paged.land(table.where(part), f"{out}/in/batch={i}", PAGE_STEP)
        yield out


@query("s04_archive", _TITLES)
def s04_archive(spark, sf):
    """Page archives read as a table, then extracted."""
    *_, out = _archive(spark, sf, "archive")
    read = paged.read_paged(spark, f"{out}/in", paged.PAGE)
    return pages.article_pages(read).select("page_id", "url", "lang", F.size("links").alias("n_links"))


@query("s04_archive_stream", _TITLES)
def s04_archive_stream(spark, sf):
    """Page archives as a stream of bounded steps; stopped, and restarted from its offset after another landing."""
    for out in _archive(spark, sf, "archive-stream"):
        rows = pages.article_pages(paged.stream_paged(spark, f"{out}/in", PAGE_STEP, paged.PAGE))
        writer = rows.select("page_id", "url", "lang", F.size("links").alias("n_links")).writeStream.format("parquet")
        writer = writer.option("path", f"{out}/items").option("checkpointLocation", f"{out}/checkpoint")
        counters.run_steps(writer.trigger(processingTime="0 seconds").start())
    return spark.read.parquet(f"{out}/items")


# Duplicates by keyed state: the events stream as items, keyed by type and user (and day), landed in two halves.

_TTL = timedelta(days=3)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _keyed_state(spark):
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, keystate.PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _visits(spark, sf, daily):
    rows = read_table(spark, sf, "events")
    return ingest.fill(rows.select(
        F.col("event_id").cast("string").alias("uuid"), F.concat(F.lit(" "), "event_type").alias("title"),
        F.format_string("user %d", "user_id").alias("venue"), F.col("ts").alias("scraped_at"),
        (F.date_format("ts", "yyyy-MM-dd") if daily else F.lit(None).cast("string")).alias("date"),
        F.col("value").cast("string").alias("price"), F.lit(False).alias("is_update_job"),
    ), ingest.ITEM)


def _halves(visits):
    """The earlier and the later half of the items. The cut is found once: the approximate median depends on the order in
    which its parts are merged, and two halves with cuts of their own would lose the items between them."""
    at = F.unix_micros("scraped_at")
    cut = F.lit(visits.agg(F.percentile_approx(at, 0.5)).first()[0])
    return [visits.where(at <= cut), visits.where(at > cut)]


@query("x02_key_returns", f"""
WITH RECURSIVE i AS (SELECT event_id, event_type || '|' || user_id AS k, ts,
    row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id::VARCHAR) AS r FROM events),
d AS (SELECT k, r, event_id, ts AS held, true AS fresh FROM i WHERE r = 1
  UNION ALL
  SELECT i.k, i.r, i.event_id, CASE WHEN i.ts >= d.held + INTERVAL {_TTL.days} DAY THEN i.ts ELSE d.held END,
         i.ts >= d.held + INTERVAL {_TTL.days} DAY FROM d JOIN i ON d.k = i.k AND i.r = d.r + 1)
SELECT event_id::VARCHAR AS uuid FROM d WHERE fresh""")
def x02_key_returns(spark, sf):
    """Two runs of a stream over one checkpoint; a key is new again three days after it was accepted."""
    out = scratch_folder(spark, "returns")
    with _keyed_state(spark):
        for i, half in enumerate(_halves(_visits(spark, sf, daily=False))):
            half.write.parquet(f"{out}/in/{i}")
            stream = spark.readStream.schema(half.schema).parquet(f"{out}/in/*")
            marked = keystate.mark_duplicates(stream, _TTL)
            writer = marked.where("NOT duplicate").writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
            writer.option("path", f"{out}/fresh").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/fresh").select("uuid")


@query("x01_keyed_ingest", """
WITH f AS (SELECT * FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id, ts::DATE ORDER BY ts, event_id::VARCHAR) = 1)
SELECT event_id::VARCHAR AS uuid, event_type AS title, 'user ' || user_id AS venue, strftime(ts, '%Y-%m-%d') AS date,
       CASE WHEN event_type = 'view' THEN value + 1 ELSE value END AS price FROM f""")
def x01_keyed(spark, sf):
    """Two landings of items, the second with price updates of all views, into a bucketed table that no batch scans."""
    out = scratch_folder(spark, "keyed")
    visits = _visits(spark, sf, daily=True)
    views = visits.where("title = ' view'").withColumns({
        "price": (F.col("price").cast("double") + 1).cast("string"), "is_update_job": F.lit(True),
        "scraped_at": F.col("scraped_at") + F.expr("interval 1 year"),
    })
    first, second = _halves(visits)
    with _keyed_state(spark):
        for i, landed in enumerate([first, second.unionByName(views)]):
            landed.write.parquet(f"{out}/in/{i}")
            stream = spark.readStream.schema(landed.schema).parquet(f"{out}/in/*")
            keyed_ingest.keyed_ingest_stream(stream, out, f"{out}/checkpoint", "crawl", as_of=as_of(), n_buckets=16).awaitTermination()
    rows = buckets.read(spark, f"{out}/events")
    return rows.select("uuid", "title", "venue", F.col("date_raw").alias("date"), "price")
