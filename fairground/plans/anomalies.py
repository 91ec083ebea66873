"""Anomaly and data-quality detectors over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairground.functions.labels import severity_rank
from fairground.operators import anomaly, report
from fairground.operators.relations import exact_duplicates
from fairground.plans import bindings as b
from fairground.plans.bindings import NORMAL_ACTIVITY, NORMAL_LISTINGS, NORMAL_SHIPMENTS, rounded, with_sql
from fairground.plans.registry import query
from fairground.sources.tables import read_table

# Points in time inside the span of each table, so that past and future events both exist.
ACTIVITY_AS_OF = "2024-01-15 12:00:00"
LISTINGS_AS_OF = "1998-06-01 00:00:00"

_BOUNDS = """
, q AS (SELECT quantile_cont(price, 0.25) AS q1, median(price) AS med, quantile_cont(price, 0.75) AS q3,
               avg(price) AS mu, stddev_pop(price) AS sp, stddev_samp(price) AS ss FROM priced),
d AS (SELECT median(abs(price - med)) AS mad FROM priced, q),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, q3 + 3 * (q3 - q1) AS far FROM q, d),
o AS (SELECT priced.*, q3, price < lower OR price > upper AS iqr_outlier, abs(price - mu) / sp > 3 AS z_outlier,
             CASE WHEN mad = 0 THEN price <> med ELSE abs(0.6745 * (price - med) / mad) > 3.5 END AS mad_outlier,
             (price - mu) / ss AS z_score, price > upper AS expensive, price < lower AS cheap,
             CASE WHEN price > far THEN 'high' ELSE 'medium' END AS sev FROM priced, b),
u AS (SELECT * FROM o WHERE iqr_outlier OR z_outlier OR mad_outlier)
"""


@query("d01_iqr_outliers", NORMAL_ACTIVITY + _BOUNDS + "SELECT uuid, price FROM o WHERE iqr_outlier")
def d01(spark, sf):
    return anomaly.iqr_outliers(b.normal_activity(spark, sf)).select("uuid", "price")


@query("d02_z_outliers", NORMAL_ACTIVITY + _BOUNDS + "SELECT uuid, price FROM o WHERE z_outlier")
def d02(spark, sf):
    return anomaly.z_outliers(b.normal_activity(spark, sf)).select("uuid", "price")


@query("d03_mad_outliers", NORMAL_ACTIVITY + _BOUNDS + "SELECT uuid, price FROM o WHERE mad_outlier")
def d03(spark, sf):
    return anomaly.flag_outliers(b.normal_activity(spark, sf)).filter("mad_outlier").select("uuid", "price")


@query("u01_outlier_union", NORMAL_ACTIVITY + _BOUNDS + "SELECT uuid FROM u")
def u01(spark, sf):
    return anomaly.flag_outliers(b.normal_activity(spark, sf)).filter("outlier").select("uuid")


@query("d04_outlier_summary", NORMAL_ACTIVITY + _BOUNDS + """
SELECT (SELECT count(*) FROM u) AS total_outliers,
       round((SELECT count(*) FROM u) * 100.0 / count(*), 4) AS percentage,
       count(*) FILTER (iqr_outlier) AS iqr_method, count(*) FILTER (z_outlier) AS z_score_method,
       count(*) FILTER (mad_outlier) AS modified_z_score_method,
       (SELECT count(*) FROM u WHERE expensive) AS n_expensive, (SELECT count(*) FROM u WHERE cheap) AS n_cheap FROM o""")
def d04(spark, sf):
    return rounded(anomaly.outlier_summary(b.normal_activity(spark, sf)), percentage=4)


@query("d04_extreme_outliers", NORMAL_ACTIVITY + _BOUNDS + """
SELECT 'expensive' AS side, uuid, title, price, category, venue, round(z_score, 4) AS z_score
FROM (SELECT * FROM u WHERE expensive ORDER BY price DESC, uuid LIMIT 10)
UNION ALL SELECT 'cheap', uuid, title, price, category, venue, round(z_score, 4)
FROM (SELECT * FROM u WHERE cheap ORDER BY price, uuid LIMIT 10)""")
def d04_extremes(spark, sf):
    return rounded(anomaly.extreme_outliers(b.normal_activity(spark, sf)), z_score=4)


@query("d04_expensive_rows", NORMAL_ACTIVITY + _BOUNDS + """
SELECT uuid, title, 'price_outlier_expensive' AS type, sev AS severity FROM u WHERE expensive""")
def d04_rows(spark, sf):
    return anomaly.expensive_rows(b.normal_activity(spark, sf)).select("uuid", "title", "type", "severity")


@query("d05_round_prices", NORMAL_SHIPMENTS.replace("l_extendedprice AS price", "l_quantity * 100 AS price") + """
SELECT uuid, title, 'suspiciously_round_price' AS type, 'low' AS severity,
       'Price is a suspiciously round number (' || CAST(price AS BIGINT) || ' TL)' AS reason
FROM norm WHERE price >= 1000 AND price % 1000 = 0""")
def d05(spark, sf):
    df = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        (F.col("l_quantity") * 100).alias("price"),
    )
    return anomaly.round_price_rows(df)


@query("d06_psychological_pricing", NORMAL_SHIPMENTS + """
SELECT count(*) FILTER (round_even(price % 1 * 100, 0) IN (0, 99)) AS n,
       round(count(*) FILTER (round_even(price % 1 * 100, 0) IN (0, 99)) * 100.0 / count(*), 4) AS percentage
FROM priced""")
def d06(spark, sf):
    return rounded(anomaly.psychological_pricing(b.normal_shipments(spark, sf)), percentage=4)


@query("d07_free_in_paid_category", NORMAL_LISTINGS + """
SELECT uuid, title, 'free_event_in_paid_category' AS type, 'low' AS severity,
       'Free event in typically paid category (' || category || ')' AS reason
FROM norm WHERE price = 0 AND category NOT IN ('seminar', 'workshop', 'conference')""")
def d07(spark, sf):
    return anomaly.free_in_paid_rows(b.normal_listings(spark, sf))


_TEMPORAL = f"""
, t AS (
  SELECT uuid, title, 'past_event' AS type, 'medium' AS severity,
         'Event date is in the past (' || strftime(date, '%Y-%m-%d') || ')' AS reason
  FROM norm WHERE date < TIMESTAMP '{ACTIVITY_AS_OF}'
  UNION ALL SELECT uuid, title, 'far_future_event', 'low',
         'Event is more than 1 year in the future (' || strftime(date, '%Y-%m-%d') || ')'
  FROM norm WHERE date > TIMESTAMP '{ACTIVITY_AS_OF}' + INTERVAL 365 DAY
  UNION ALL SELECT uuid, title, 'unusual_time', 'low',
         'Event scheduled at unusual hour (' || strftime(date, '%H:%M') || ')'
  FROM norm WHERE hour BETWEEN 3 AND 6)
"""


@query("d08_temporal_rows", NORMAL_ACTIVITY + _TEMPORAL + "SELECT * FROM t")
def d08(spark, sf):
    as_of = F.lit(ACTIVITY_AS_OF).cast("timestamp")
    return anomaly.temporal_rows(b.normal_activity(spark, sf), as_of)


@query("d08_temporal_summary", NORMAL_LISTINGS + f"""
SELECT count(*) FILTER (date < TIMESTAMP '{LISTINGS_AS_OF}') AS n_past,
       round(count(*) FILTER (date < TIMESTAMP '{LISTINGS_AS_OF}') * 100.0 / count(date), 4) AS pct_past,
       count(*) FILTER (date > TIMESTAMP '{LISTINGS_AS_OF}' + INTERVAL 365 DAY) AS n_far_future,
       count(*) FILTER (hour BETWEEN 3 AND 6) AS n_unusual FROM norm""")
def d08_summary(spark, sf):
    as_of = F.lit(LISTINGS_AS_OF).cast("timestamp")
    return rounded(anomaly.temporal_summary(b.normal_listings(spark, sf), as_of), pct_past=4)


@query("q01_quality", NORMAL_LISTINGS + """
, c AS (SELECT count(*) AS total, count(*) FILTER (description_length = 0) AS a,
               count(*) FILTER (description_length > 0 AND description_length < 50) AS s,
               count(*) FILTER (venue IN ('unknown', '')) AS v, count(*) FILTER (category IN ('unknown', '')) AS g,
               count(*) FILTER (date IS NULL) AS d FROM norm),
t AS (SELECT total, unnest([('missing_description', a), ('short_description', s), ('missing_venue', v),
                     ('missing_category', g), ('missing_date', d)]) AS p FROM c)
SELECT p[1] AS issue, p[2] AS n, round(p[2] * 100.0 / total, 4) AS pct FROM t""")
def q01(spark, sf):
    return rounded(anomaly.quality(b.normal_listings(spark, sf)), pct=4)


@query("q01_missing_description_rows", NORMAL_LISTINGS + """
SELECT uuid, title, 'missing_description' AS type, 'medium' AS severity, 'Event has no description' AS reason
FROM norm WHERE description_length = 0""")
def q01_rows(spark, sf):
    return anomaly.missing_description_rows(b.normal_listings(spark, sf))


@query("q02_completeness", NORMAL_LISTINGS + """
SELECT round(100 - (count(*) FILTER (description_length = 0) + count(*) FILTER (venue IN ('unknown', ''))
       + count(*) FILTER (category IN ('unknown', '')) + count(*) FILTER (date IS NULL)) * 100.0
       / (count(*) * 4), 4) AS completeness FROM norm""")
def q02(spark, sf):
    return rounded(anomaly.completeness(b.normal_listings(spark, sf)), completeness=4)


@query("q03_integrity_checks", with_sql(b.LISTINGS) + """
, d AS (SELECT count(*) AS sets FROM (SELECT 1 FROM listings GROUP BY title, venue, date HAVING count(*) > 1)),
c AS (SELECT count(*) AS total, count(*) FILTER (coalesce(title, '') = '') AS mt, count(*) FILTER (date IS NULL) AS md,
             count(*) FILTER (coalesce(url, '') = '') AS mu, count(price) AS pr,
             count(*) FILTER (price IS NULL) AS mp, count(*) FILTER (price = 0) AS zp,
             count(*) FILTER (price = 250) AS dp, count(*) FILTER (length(title) < 3) AS st FROM listings),
t AS (SELECT unnest([
  {'check': 'missing_title', 'n': mt, 'failed': mt > 0}, {'check': 'missing_date', 'n': md, 'failed': md > 0},
  {'check': 'missing_url', 'n': mu, 'failed': mu > 0}, {'check': 'priced', 'n': pr, 'failed': pr = 0 AND total > 0},
  {'check': 'missing_price', 'n': mp, 'failed': false}, {'check': 'zero_price', 'n': zp, 'failed': false},
  {'check': 'default_price', 'n': dp, 'failed': false},
  {'check': 'mostly_unpriced', 'n': CAST(mp > total * 0.5 AS BIGINT), 'failed': false},
  {'check': 'short_title', 'n': st, 'failed': st > 0}, {'check': 'duplicate_sets', 'n': sets, 'failed': sets > 0}
  ]) AS r FROM c, d)
SELECT r['check'] AS "check", r['n'] AS n, r['failed'] AS failed FROM t""")
def q03(spark, sf):
    df = b.listings(spark, sf)
    return anomaly.integrity_checks(df, exact_duplicates(df))


@query("d10_single_event_venues", NORMAL_SHIPMENTS.replace("'supplier ' || l_suppkey", "'part ' || l_partkey") + """
, v AS (SELECT venue, count(*) AS n FROM norm GROUP BY venue)
SELECT count(*) FILTER (n = 1) AS n, round(count(*) FILTER (n = 1) * 100.0 / count(*), 4) AS percentage FROM v""")
def d10(spark, sf):
    df = b.normal_shipments(spark, sf).withColumn("venue", F.replace("title", F.lit("Part"), F.lit("part")))
    return rounded(anomaly.single_event_venues(df), percentage=4)


@query("d11_high_variance_venues", NORMAL_ACTIVITY + """
, v AS (SELECT venue, avg(price) AS m, stddev_samp(price) AS s, count(*) AS n FROM priced GROUP BY venue)
SELECT venue, round(m, 8) AS mean_price, round(s, 4) AS std_dev, n, round(s / m * 100, 4) AS cv FROM v
WHERE s / m > 1 AND n >= 5 ORDER BY s DESC, venue LIMIT 10""")
def d11(spark, sf):
    return rounded(anomaly.high_variance_venues(b.normal_activity(spark, sf)), mean_price=8, std_dev=4, cv=4)


_ALL = NORMAL_ACTIVITY + _BOUNDS + _TEMPORAL + """
, found AS (
  SELECT uuid, type, severity FROM t
  UNION ALL SELECT uuid, 'price_outlier_expensive', sev FROM u WHERE expensive
  UNION ALL SELECT uuid, 'suspiciously_round_price', 'low' FROM norm WHERE price >= 1000 AND price % 1000 = 0
  UNION ALL SELECT uuid, 'free_event_in_paid_category', 'low' FROM norm
  WHERE price = 0 AND category NOT IN ('seminar', 'workshop', 'conference')
  UNION ALL SELECT uuid, 'missing_description', 'medium' FROM norm WHERE description_length = 0)
"""


def _all_rows(spark, sf):
    df = b.normal_activity(spark, sf)
    return df, anomaly.anomaly_rows(df, F.lit(ACTIVITY_AS_OF).cast("timestamp"))


@query("d09_anomaly_counts", _ALL + "SELECT type, severity, count(*) AS n FROM found GROUP BY type, severity")
def d09(spark, sf):
    return anomaly.anomaly_counts(_all_rows(spark, sf)[1])


@query("d09_anomaly_rate", _ALL + """
SELECT (SELECT count(*) FROM norm) AS total_events, count(*) AS total_anomalies,
       round(count(*) * 100.0 / (SELECT count(*) FROM norm), 4) AS anomaly_rate FROM found""")
def d09_rate(spark, sf):
    return rounded(anomaly.anomaly_rate(*_all_rows(spark, sf)), anomaly_rate=4)


@query("d09_top_anomalies", _ALL + """
SELECT CAST(uuid AS VARCHAR) AS uuid, type, severity FROM found
ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, CAST(uuid AS VARCHAR), type LIMIT 50""")
def d09_top(spark, sf):
    return anomaly.top_anomalies(_all_rows(spark, sf)[1]).select("uuid", "type", "severity")


@query("d09_reported_rows", _ALL + """
SELECT CAST(uuid AS VARCHAR) AS uuid, type, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY CAST(uuid AS VARCHAR)) AS i FROM found) WHERE i <= 20""")
def d09_reported(spark, sf):
    return anomaly.reported_rows(_all_rows(spark, sf)[1]).select("uuid", "type", "severity")


@query("u02_all_detectors", _ALL + "SELECT CAST(uuid AS VARCHAR) AS uuid, type, severity FROM found")
def u02(spark, sf):
    return _all_rows(spark, sf)[1].select("uuid", "type", "severity")


@query("d12_anomaly_score", _ALL + """
SELECT CAST(uuid AS VARCHAR) AS uuid,
       CAST(least(coalesce(sum(CASE severity WHEN 'high' THEN 40 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 END), 0), 100)
            AS BIGINT) AS score
FROM norm LEFT JOIN found USING (uuid) GROUP BY uuid""")
def d12(spark, sf):
    return anomaly.anomaly_score(*_all_rows(spark, sf))


@query("a15_full_report", _ALL + """
, m AS (SELECT avg(price) AS mu FROM priced),
s AS (SELECT avg(power(price - mu, 3)) / power(avg(power(price - mu, 2)), 1.5) AS skewness,
             avg(power(price - mu, 4)) / power(avg(power(price - mu, 2)), 2) - 3 AS kurtosis FROM priced, m)
SELECT (SELECT count(*) FROM norm) AS total_events, round_even(avg(price), 2) AS mean_price,
       round_even(median(price), 2) AS median_price, round_even(stddev_samp(price), 2) AS std_dev,
       round_even(min(price), 2) AS min_price, round_even(max(price), 2) AS max_price,
       (SELECT count(DISTINCT category) FROM norm) AS total_categories,
       (SELECT count(DISTINCT venue) FROM norm) AS total_venues,
       (SELECT CASE WHEN abs(skewness) < 0.5 THEN 'approximately symmetric' WHEN skewness > 0
               THEN 'right-skewed (positively skewed)' ELSE 'left-skewed (negatively skewed)' END FROM s) AS shape,
       (SELECT round_even(skewness, 3) FROM s) AS skewness, (SELECT round_even(kurtosis, 3) FROM s) AS kurtosis,
       round_even(quantile_cont(price, 0.25), 2) AS q1, round_even(quantile_cont(price, 0.75), 2) AS q3,
       round_even(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 2) AS iqr,
       (SELECT count(*) FROM found) AS total_anomalies,
       round_even((SELECT count(*) FROM found) * 100.0 / (SELECT count(*) FROM norm), 2) AS anomaly_rate,
       (SELECT count(*) FROM u) AS price_outliers FROM priced""")
def a15(spark, sf):
    # The normality verdict has no SQL; h03_ks_normal covers it.
    row = report.full_report(b.normal_activity(spark, sf), F.lit(ACTIVITY_AS_OF).cast("timestamp"))
    return row.drop("is_normal", "conclusion")


@query("f35_severity_labels", NORMAL_ACTIVITY + _BOUNDS + """
SELECT uuid, CASE sev WHEN 'high' THEN 3 ELSE 2 END AS severity_rank FROM u WHERE expensive""")
def f35(spark, sf):
    rows = anomaly.expensive_rows(b.normal_activity(spark, sf))
    return rows.select("uuid", severity_rank(F.col("severity")).alias("severity_rank"))
