"""Dashboard roll-ups, top-k lists and progress over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from fairground.functions import labels
from fairground.operators import rollups, stats
from fairground.operators.filters import specific_category
from fairground.operators.normalize import display_card, normalize_events, short_title
from fairground.operators.relations import with_summary
from fairground.plans import bindings as b
from fairground.plans.bindings import NORMAL_ACTIVITY, NORMAL_LISTINGS, NORMAL_SHIPMENTS, rounded, with_sql
from fairground.plans.registry import query
from fairground.sources.tables import read_table

_ARTICLE_REVIEWS = with_sql(b.ARTICLES, b.REVIEWS)


@query("a11_headline", with_sql(b.LISTINGS) + """
SELECT count(*) AS total_events, round(avg(price) FILTER (price > 0), 8) AS mean_price,
       count(DISTINCT venue) AS total_venues, round(median(price) FILTER (price > 0), 4) AS median_price FROM listings""")
def a11(spark, sf):
    return rounded(rollups.headline(b.listings(spark, sf)), mean_price=8, median_price=4)


@query("a12_category_counts", with_sql(b.LISTINGS) + """
SELECT category, count(*) AS n FROM listings GROUP BY category ORDER BY n DESC, category LIMIT 10""")
def a12(spark, sf):
    return rollups.top_values(b.listings(spark, sf), "category", 10)


@query("a13_mean_price_by_category", NORMAL_SHIPMENTS + """
SELECT category, CAST(floor(avg(price)) AS INT) AS price FROM priced GROUP BY category
ORDER BY price DESC, category LIMIT 10""")
def a13(spark, sf):
    return rollups.mean_price_by_category(b.normal_shipments(spark, sf))


@query("a14_five_numbers", NORMAL_ACTIVITY + """
SELECT min(price) AS min, round(quantile_cont(price, 0.25), 4) AS q1, round(median(price), 4) AS median,
       round(quantile_cont(price, 0.75), 4) AS q3, max(price) AS max FROM priced""")
def a14(spark, sf):
    return rounded(rollups.five_numbers(b.normal_activity(spark, sf)), q1=4, median=4, q3=4)


@query("a14_sample_members", NORMAL_ACTIVITY + "SELECT least(500, count(*)) AS n, least(500, count(*)) AS n_stored FROM priced")
def a14_members(spark, sf):
    """Size of the chart's sample, and how many of its prices are stored ones."""
    df = b.normal_activity(spark, sf)
    sample = rollups.price_sample(df, seed=42)
    known = sample.join(df.select("price").distinct(), "price", "left_semi")
    return sample.agg(F.count("*").alias("n")).withColumn("n_stored", known.agg(F.count("*")).scalar())


@query("a14_price_sample")
def a14_sample(spark, sf):
    return rollups.price_sample(b.normal_activity(spark, sf), seed=42)


@query("a16_category_detail", NORMAL_LISTINGS + """
SELECT category AS name, count(*) AS n, round_even(avg(price), 2) AS mean_price,
       round_even(median(price), 2) AS median_price, round_even(quantile_cont(price, 0.25), 2) AS q1,
       round_even(quantile_cont(price, 0.75), 2) AS q3, round_even(coalesce(stddev_samp(price), 0), 2) AS std_dev
FROM priced GROUP BY category""")
def a16(spark, sf):
    return rollups.category_detail(b.normal_listings(spark, sf))


@query("a17_monthly", with_sql(b.LISTINGS) + """
SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM listings GROUP BY month ORDER BY month LIMIT 12""")
def a17(spark, sf):
    return rollups.monthly(b.listings(spark, sf))


@query("a17_monthly_latest", with_sql(b.LISTINGS) + """
SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM listings GROUP BY month ORDER BY month DESC LIMIT 12""")
def a17_latest(spark, sf):
    return rollups.monthly(b.listings(spark, sf), latest=True)


@query("a18_weekly", with_sql(b.LISTINGS) + """
SELECT strftime(date, '%Y-W%W') AS week, count(*) AS n,
       round(coalesce(avg(price) FILTER (price > 0), 0), 8) AS avg_price
FROM listings GROUP BY week ORDER BY week DESC LIMIT 16""")
def a18(spark, sf):
    return rounded(rollups.weekly(b.listings(spark, sf)), avg_price=8)


@query("a19_day_of_week", with_sql(b.LISTINGS) + """
SELECT ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][i + 1] AS day, count(uuid) AS n,
       round(coalesce(avg(price) FILTER (price > 0), 0), 8) AS avg_price
FROM range(7) r(i) LEFT JOIN listings ON isodow(date) - 1 = i GROUP BY i""")
def a19(spark, sf):
    return rounded(rollups.day_of_week(b.listings(spark, sf)), avg_price=8)


_BAND = "CASE WHEN price <= 300 THEN 0 WHEN price <= 800 THEN 1 WHEN price <= 2000 THEN 2 ELSE 3 END"


@query("a20_price_bands", NORMAL_LISTINGS + f"""
SELECT ['Budget', 'Mid-Range', 'Premium', 'Luxury'][i + 1] AS band, count(uuid) AS n,
       round(coalesce(avg(price), 0), 8) AS avg_price
FROM range(4) r(i) LEFT JOIN priced ON {_BAND} = i GROUP BY i""")
def a20(spark, sf):
    return rounded(rollups.price_bands(b.normal_listings(spark, sf)), avg_price=8)


@query("a21_top_category_prices", NORMAL_ACTIVITY + """
SELECT category, count(*) AS n, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std, min(price) AS min,
       max(price) AS max, round(median(price), 4) AS median
FROM priced GROUP BY category ORDER BY n DESC, category LIMIT 10""")
def a21(spark, sf):
    return rounded(rollups.top_category_prices(b.normal_activity(spark, sf)), mean=4, std=4, median=4)


@query("a22_progress", _ARTICLE_REVIEWS + """
, e AS (SELECT count(*) AS total_events, count(*) AS events_with_dates,
               count(*) FILTER (category <> 'en') AS events_with_categories FROM articles),
s AS (SELECT count(*) AS total_summaries FROM reviews)
SELECT total_events, events_with_dates, events_with_categories, total_summaries,
       round_even(total_summaries * 100.0 / total_events, 1) AS summary_pct,
       round_even(events_with_dates * 100.0 / total_events, 1) AS date_pct,
       round_even(events_with_categories * 100.0 / total_events, 1) AS category_pct,
       total_events - total_summaries AS remaining FROM e, s""")
def a22(spark, sf):
    # English articles stand for the generic category; every article is dated.
    generic = F.when(F.col("category") == "en", "Etkinlik").otherwise(F.col("category"))
    df = b.articles(spark, sf).withColumn("category", generic).withColumn("date", F.col("venue"))
    return rollups.progress(df, b.reviews(spark, sf))


@query("a35_quality_gauge", NORMAL_LISTINGS + """
SELECT CAST(floor(100 - count(*) FILTER (price = 0) * 100.0 / count(*) + 0.5) AS INT) AS gauge FROM norm""")
def a35(spark, sf):
    return stats.free_share(b.normal_listings(spark, sf)).select(rollups.gauge(F.col("pct_free")).alias("gauge"))


@query("a36_top_category_means", NORMAL_LISTINGS + """
, t AS (SELECT category FROM norm GROUP BY category ORDER BY count(*) DESC, category LIMIT 8)
SELECT category, round(avg(price), 8) AS mean_price FROM priced SEMI JOIN t USING (category) GROUP BY category""")
def a36(spark, sf):
    return rounded(rollups.top_category_means(b.normal_listings(spark, sf)), mean_price=8)


@query("a37_numeric_box_plot", """
WITH p AS (SELECT TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS price FROM events),
q AS (SELECT quantile_cont(price, 0.25) AS q1, median(price) AS median, quantile_cont(price, 0.75) AS q3,
             min(price) AS lo, max(price) AS hi, avg(price) AS mean FROM p WHERE price > 0)
SELECT lo AS min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, hi AS max,
       round(mean, 4) AS mean, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 4) AS lower_whisker,
       round(least(hi, q3 + 1.5 * (q3 - q1)), 4) AS upper_whisker, 0 AS n_outliers FROM q""")
def a37(spark, sf):
    # Prices stored as text: the number in the event properties.
    number = F.regexp_extract("description", "([0-9]+)", 1)
    out = stats.box_plot(normalize_events(b.activity(spark, sf).withColumn("price", number)))
    return rounded(out, q1=4, median=4, q3=4, mean=4, lower_whisker=4, upper_whisker=4)


@query("t01_featured", with_sql(b.ARTICLES, b.REVIEWS) + """
, j AS (SELECT * FROM articles JOIN reviews ON uuid = event_uuid),
k AS (SELECT 'cheapest' AS bucket, * FROM (SELECT * FROM j WHERE price > 0 ORDER BY price, uuid LIMIT 3)
      UNION ALL SELECT 'medium', * FROM (SELECT * FROM j WHERE price BETWEEN 400 AND 700
                                         ORDER BY quality_score DESC, uuid LIMIT 3)
      UNION ALL SELECT 'premium', * FROM (SELECT * FROM j WHERE price > 0 ORDER BY price DESC, uuid LIMIT 3))
SELECT bucket, title, price, venue, category, '' AS date,
       CASE WHEN length(sentiment_summary) > 200 THEN sentiment_summary[1:200] || '...' ELSE sentiment_summary END
         AS summary, quality_score FROM k""")
def t01(spark, sf):
    events = b.articles(spark, sf).withColumn("date", F.lit(None).cast("timestamp"))
    return rollups.featured(events, b.reviews(spark, sf))


@query("p10_display_card", with_sql(b.ARTICLES, b.REVIEWS) + """
SELECT title, price, venue, category, '' AS date,
       CASE WHEN length(sentiment_summary) > 200 THEN sentiment_summary[1:200] || '...' ELSE sentiment_summary END
         AS summary, quality_score FROM articles JOIN reviews ON uuid = event_uuid""")
def p10(spark, sf):
    events = b.articles(spark, sf).withColumn("date", F.lit(None).cast("timestamp"))
    return display_card(with_summary(events, b.reviews(spark, sf)))


@query("p11_short_title", """
SELECT doc_id, CASE WHEN length(text) > 50 THEN text[1:50] || '...' ELSE text END AS title FROM documents""")
def p11(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", short_title(F.col("text")).alias("title"))


@query("p17_chart_filter", NORMAL_LISTINGS + """
SELECT category, count(*) AS n FROM norm WHERE category IS NOT NULL AND category <> '5-LOW' AND price <= 3000
GROUP BY category ORDER BY n DESC, category LIMIT 10""")
def p17(spark, sf):
    df = b.normal_listings(spark, sf).filter(F.col("price") <= 3000)
    return rollups.top_values(df.filter(specific_category(F.col("category"), "5-LOW")), "category", 10)


@query("t02_scatter", with_sql(b.ARTICLES, b.REVIEWS) + """
SELECT price, CAST(quality_score AS INT) AS quality, coalesce(nullif(category, ''), 'Other') AS category
FROM articles JOIN reviews ON uuid = event_uuid WHERE price > 0 AND quality_score IS NOT NULL ORDER BY uuid LIMIT 500""")
def t02(spark, sf):
    return rollups.scatter(b.articles(spark, sf), b.reviews(spark, sf))


@query("t03_latest_summaries", with_sql(b.ARTICLES, b.REVIEWS) + """
SELECT title, quality_score, category FROM articles JOIN reviews ON uuid = event_uuid
GROUP BY ALL ORDER BY max(updated_at) DESC, title, quality_score, category LIMIT 3""")
def t03(spark, sf):
    return rollups.latest_summaries(b.articles(spark, sf), b.reviews(spark, sf))


@query("t04_top_venues", NORMAL_ACTIVITY + """
SELECT venue, count(*) AS n FROM norm GROUP BY venue ORDER BY n DESC, venue LIMIT 10""")
def t04(spark, sf):
    return rollups.top_values(b.normal_activity(spark, sf), "venue", 10)


@query("w03_last_snapshots", """
SELECT event_id, user_id, rank FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
WHERE rank <= 20""")
def w03(spark, sf):
    df = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    return rollups.last_n(df, 20, "ts", "user_id", "event_id").select("event_id", "user_id", "rank")


_SNAPSHOTS = """
WITH s AS (SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT event_type, ts, sum(n) OVER (PARTITION BY event_type ORDER BY ts) AS total FROM s)
"""


def snapshots(spark, sf):
    """Hourly progress snapshots: the running total of events per type."""
    hourly = read_table(spark, sf, "events").groupBy(
        "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(F.count(F.lit(1)).alias("n"))
    # One row per type and hour: the window holds hours, not events.
    running = F.sum("n").over(W.partitionBy("event_type").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    return hourly.select("event_type", "ts", running.alias("total"))


@query("w01_rolling_rate", _SNAPSHOTS + """
, r AS (SELECT event_type, ts, total - first_value(total) OVER w AS d, epoch(ts) - epoch(first_value(ts) OVER w) AS s,
               count(*) OVER w AS k FROM c
        WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_type, epoch(ts)::BIGINT AS ts,
       CASE WHEN k >= 2 THEN round(CASE WHEN s > 0 THEN d / s * 60 ELSE 0 END, 6) END AS per_minute FROM r""")
def w01(spark, sf):
    df = rollups.rolling_rate(snapshots(spark, sf), "total", "event_type")
    return df.select("event_type", F.col("ts").cast("long").alias("ts"), F.round("per_minute", 6).alias("per_minute"))


@query("w02_eta", _SNAPSHOTS + """
, l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS i FROM c),
r AS (SELECT event_type, (max(total) - min(total)) / (epoch(max(ts)) - epoch(min(ts))) * 60 AS rate FROM l
      WHERE i <= 5 GROUP BY event_type),
m AS (SELECT event_type, 10000 / rate AS minutes FROM r)
SELECT event_type, CASE WHEN minutes < 60 THEN '~' || CAST(ceil(minutes) AS BIGINT) || ' min'
  ELSE '~' || CAST(floor(minutes / 60) AS BIGINT) || 'h '
       || CAST(floor(minutes - floor(minutes / 60) * 60 + 0.5) AS BIGINT) || 'm' END AS eta FROM m""")
def w02(spark, sf):
    latest = rollups.last_n(rollups.rolling_rate(snapshots(spark, sf), "total", "event_type"), 1, "ts", "event_type")
    return latest.select("event_type", rollups.eta_text(F.lit(10000), F.col("per_minute")).alias("eta"))


@query("w07_pie_shares", NORMAL_LISTINGS + """
, t AS (SELECT category, count(*) AS n FROM norm WHERE category <> 'Etkinlik' GROUP BY category
        ORDER BY n DESC, category LIMIT 6)
SELECT category, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM t""")
def w07(spark, sf):
    return rounded(rollups.pie_shares(b.normal_listings(spark, sf)), pct=6)


@query("f40_quality_band", with_sql(b.REVIEWS) + """
SELECT event_uuid, CASE WHEN quality_score >= 8 THEN 'high' WHEN quality_score >= 6 THEN 'medium' ELSE 'low' END AS band
FROM reviews""")
def f40(spark, sf):
    return b.reviews(spark, sf).select("event_uuid", labels.quality_band(F.col("quality_score")).alias("band"))
