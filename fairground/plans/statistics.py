"""Normalisation, descriptive statistics and hypothesis tests over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairground.functions.pvalues import QUANTILE_TERMS
from fairground.operators import hypothesis, stats
from fairground.operators.normalize import normalize_events
from fairground.plans.bindings import (
    ARTICLES, NORMAL_ACTIVITY, NORMAL_LISTINGS, NORMAL_SHIPMENTS, articles, normal_activity, normal_listings,
    normal_shipments, normalized, rounded, with_sql,
)
from fairground.plans.registry import query


@query("p01_normalize_events", NORMAL_LISTINGS + """
SELECT uuid, price, category, venue, has_description, description_length, month, day_of_week, hour FROM norm""")
def p01(spark, sf):
    df = normal_listings(spark, sf)
    return df.select("uuid", "price", "category", "venue", "has_description", "description_length", "month",
                     "day_of_week", "hour")


@query("a01_price_summary", NORMAL_SHIPMENTS + """
SELECT count(*) AS n, round(avg(price), 2) AS mean, round(stddev_samp(price), 2) AS std,
       round(var_samp(price) / 1e6, 2) AS variance_m, min(price) AS min, max(price) AS max,
       round(stddev_samp(price) / avg(price) * 100, 4) AS cv, round(median(price), 2) AS median FROM priced""")
def a01(spark, sf):
    df = stats.price_summary(normal_shipments(spark, sf))
    df = df.withColumn("variance_m", F.col("variance") / 1e6).drop("variance")
    return rounded(df, mean=2, std=2, variance_m=2, cv=4, median=2)


@query("a02_free_share", NORMAL_LISTINGS + """
SELECT count(*) FILTER (price = 0) AS n_free, round(count(*) FILTER (price = 0) * 100.0 / count(*), 4) AS pct_free
FROM norm""")
def a02(spark, sf):
    return rounded(stats.free_share(normal_listings(spark, sf)), pct_free=4)


@query("a03_value_counts", NORMAL_LISTINGS + """
SELECT 'category' AS field, category AS value, count(*) AS n FROM norm GROUP BY category
UNION ALL SELECT 'venue', venue, count(*) FROM norm GROUP BY venue""")
def a03(spark, sf):
    return stats.value_counts(normal_listings(spark, sf), "category", "venue")


@query("a03_distinct_counts", NORMAL_ACTIVITY + """
SELECT count(DISTINCT category) AS n_category, count(DISTINCT venue) AS n_venue FROM norm""")
def a03_distinct(spark, sf):
    return stats.distinct_counts(normal_activity(spark, sf), "category", "venue")


@query("a04_description_quality", NORMAL_LISTINGS + """
SELECT count(*) FILTER (has_description) AS n_described,
       round(count(*) FILTER (has_description) * 100.0 / count(*), 4) AS pct_described,
       round(avg(description_length), 4) AS avg_length FROM norm""")
def a04(spark, sf):
    return rounded(stats.description_quality(normal_listings(spark, sf)), pct_described=4, avg_length=4)


@query("a05_price_shape", NORMAL_ACTIVITY + """
, m AS (SELECT avg(price) AS mu FROM priced),
c AS (SELECT avg(power(price - mu, 2)) AS m2, avg(power(price - mu, 3)) AS m3, avg(power(price - mu, 4)) AS m4,
             max(price) - min(price) AS range, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr
      FROM priced, m),
s AS (SELECT m3 / power(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis, range, iqr FROM c)
SELECT round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis,
       CASE WHEN abs(skewness) < 0.5 THEN 'approximately symmetric'
            WHEN skewness > 0 THEN 'right-skewed (positively skewed)'
            ELSE 'left-skewed (negatively skewed)' END AS shape,
       CASE WHEN abs(kurtosis) < 1 THEN 'mesokurtic (normal-like tails)'
            WHEN kurtosis > 0 THEN 'leptokurtic (heavy tails, peaked)'
            ELSE 'platykurtic (light tails, flat)' END AS tails,
       round(range, 4) AS range, round(iqr, 4) AS iqr FROM s""")
def a05(spark, sf):
    return rounded(stats.price_shape(normal_activity(spark, sf)), skewness=5, kurtosis=5, range=4, iqr=4)


@query("a05_price_modes", NORMAL_SHIPMENTS + """
, c AS (SELECT price, count(*) AS n FROM priced GROUP BY price)
SELECT price, n FROM c WHERE n = (SELECT max(n) FROM c)""")
def a05_modes(spark, sf):
    return stats.modes(normal_shipments(spark, sf))


_QUARTILES = """
, q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
               quantile_cont(price, 0.75) AS q3, min(price) AS lo, max(price) AS hi, avg(price) AS mean,
               quantile_cont(price, 0.05) AS p5, quantile_cont(price, 0.1) AS p10, quantile_cont(price, 0.9) AS p90,
               quantile_cont(price, 0.95) AS p95, quantile_cont(price, 0.99) AS p99 FROM priced),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
"""


@query("a06_quartiles", NORMAL_ACTIVITY + _QUARTILES + """
SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(iqr, 4) AS iqr,
       round(greatest(lo, lower_fence), 4) AS lower_whisker, round(least(hi, upper_fence), 4) AS upper_whisker,
       (SELECT count(*) FROM priced, f WHERE price < lower_fence OR price > upper_fence) AS n_outliers,
       round((SELECT count(*) FROM priced, f WHERE price < lower_fence OR price > upper_fence) * 100.0
             / (SELECT count(*) FROM priced), 4) AS pct_outliers,
       round(p5, 4) AS p5, round(p10, 4) AS p10, round(q1, 4) AS p25, round(median, 4) AS p50, round(q3, 4) AS p75,
       round(p90, 4) AS p90, round(p95, 4) AS p95, round(p99, 4) AS p99 FROM f""")
def a06(spark, sf):
    df = stats.quartiles(normal_activity(spark, sf))
    return rounded(df, **{c: 4 for c in df.columns if c != "n_outliers"})


@query("a06_outlier_values", NORMAL_ACTIVITY + _QUARTILES + """
SELECT price FROM priced, f WHERE price < lower_fence OR price > upper_fence""")
def a06_values(spark, sf):
    return stats.outlier_values(normal_activity(spark, sf))


@query("a07_box_plot", NORMAL_ACTIVITY + _QUARTILES + """
SELECT round(lo, 4) AS min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(hi, 4) AS max, round(mean, 4) AS mean, round(greatest(lo, lower_fence), 4) AS lower_whisker,
       round(least(hi, upper_fence), 4) AS upper_whisker,
       (SELECT count(*) FROM priced, f WHERE price < greatest(lo, lower_fence) OR price > least(hi, upper_fence))
         AS n_outliers FROM f""")
def a07(spark, sf):
    df = stats.box_plot(normal_activity(spark, sf))
    return rounded(df, **{c: 4 for c in df.columns if c != "n_outliers"})


@query("a07_box_plot_by_category", NORMAL_ACTIVITY + """
, q AS (SELECT category, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
               quantile_cont(price, 0.75) AS q3, min(price) AS lo, max(price) AS hi, avg(price) AS mean
        FROM priced GROUP BY category),
w AS (SELECT *, greatest(lo, q1 - 1.5 * (q3 - q1)) AS lower_whisker, least(hi, q3 + 1.5 * (q3 - q1)) AS upper_whisker
      FROM q)
SELECT w.category, round(any_value(lo), 4) AS min, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
       round(any_value(q3), 4) AS q3, round(any_value(hi), 4) AS max, round(any_value(mean), 4) AS mean,
       round(any_value(lower_whisker), 4) AS lower_whisker, round(any_value(upper_whisker), 4) AS upper_whisker,
       count(*) FILTER (price < lower_whisker OR price > upper_whisker) AS n_outliers
FROM w JOIN priced USING (category) GROUP BY w.category""")
def a07_by(spark, sf):
    df = stats.box_plot(normal_activity(spark, sf), by="category")
    return rounded(df, **{c: 4 for c in df.columns if c not in ("category", "n_outliers")})


@query("a08_category_stats", NORMAL_LISTINGS + """
SELECT category, count(*) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std,
       round(quantile_cont(price, 0.25), 8) AS q1, round(median(price), 8) AS median,
       round(quantile_cont(price, 0.75), 8) AS q3 FROM priced GROUP BY category""")
def a08(spark, sf):
    return rounded(stats.category_stats(normal_listings(spark, sf)), mean=4, std=4, q1=8, median=8, q3=8)


@query("a09_temporal_counts", NORMAL_ACTIVITY + """
SELECT 'month' AS part, month AS key, count(*) AS n FROM norm WHERE date IS NOT NULL GROUP BY month
UNION ALL SELECT 'day_of_week', day_of_week, count(*) FROM norm WHERE date IS NOT NULL GROUP BY day_of_week
UNION ALL SELECT 'hour', hour, count(*) FROM norm WHERE date IS NOT NULL GROUP BY hour""")
def a09(spark, sf):
    return stats.temporal_counts(normal_activity(spark, sf))


@query("a09_busiest", NORMAL_LISTINGS + """
SELECT (SELECT month FROM norm GROUP BY month ORDER BY count(*) DESC, month LIMIT 1) AS busiest_month,
       (SELECT ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][day_of_week + 1]
        FROM norm GROUP BY day_of_week ORDER BY count(*) DESC, day_of_week LIMIT 1) AS busiest_day""")
def a09_busiest(spark, sf):
    return stats.busiest(normal_listings(spark, sf))


@query("a10_correlations", NORMAL_ACTIVITY + """
, r AS (SELECT corr(price, description_length) AS r1, corr(price, day_of_week) AS r2, corr(price, hour) AS r3,
               corr(description_length, day_of_week) AS r4, corr(description_length, hour) AS r5,
               corr(day_of_week, hour) AS r6 FROM norm),
t AS (SELECT unnest([('price', 'description_length', r1), ('price', 'day_of_week', r2), ('price', 'hour', r3),
                     ('description_length', 'day_of_week', r4), ('description_length', 'hour', r5),
                     ('day_of_week', 'hour', r6)]) AS p FROM r),
u AS (SELECT p[1] AS variable_1, p[2] AS variable_2, p[3] AS r FROM t)
SELECT variable_1, variable_2, round(r, 6) AS r,
       CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' WHEN abs(r) >= 0.3 THEN 'Weak'
            ELSE 'Very weak' END || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END AS strength FROM u""")
def a10(spark, sf):
    # All activity falls in one month, so that feature has no variance here.
    features = ("price", "description_length", "day_of_week", "hour")
    return rounded(stats.correlations(normal_activity(spark, sf), features), r=6)


_ARTICLES = with_sql(ARTICLES.replace("source AS venue", "source AS venue, CAST('2024-01-01' AS TIMESTAMP) AS date"),
                     normalized("articles"))


@query("a10_strong_correlations", _ARTICLES + """
SELECT 'price' AS variable_1, 'description_length' AS variable_2, round(corr(price, description_length), 6) AS r,
       'Strong positive' AS strength FROM norm HAVING corr(price, description_length) >= 0.7""")
def a10_strong(spark, sf):
    df = normalize_events(articles(spark, sf).withColumn("date", F.lit("2024-01-01 00:00:00")))
    return rounded(stats.strong_correlations(df, ("price", "description_length")), r=6)


@query("a34_interpretation", NORMAL_LISTINGS + """
, s AS (SELECT stddev_samp(price) / avg(price) * 100 AS cv, avg(price) AS mu FROM priced),
k AS (SELECT avg(power(price - mu, 3)) / power(avg(power(price - mu, 2)), 1.5) AS skew FROM priced, s),
c AS (SELECT 100 - (count(*) FILTER (description_length = 0) + count(*) FILTER (venue IN ('unknown', ''))
             + count(*) FILTER (category IN ('unknown', '')) + count(*) FILTER (date IS NULL)) * 100.0
             / (count(*) * 4) AS completeness FROM norm)
SELECT CASE WHEN cv > 100 THEN 'high' WHEN cv > 50 THEN 'moderate' ELSE 'consistent' END AS variability,
       CASE WHEN skew > 1 THEN 'strong' WHEN skew > 0.5 THEN 'moderate' ELSE 'symmetric' END AS skew,
       round(completeness, 4) AS completeness,
       CASE WHEN completeness >= 90 THEN 'Excellent' WHEN completeness >= 75 THEN 'Good'
            WHEN completeness >= 60 THEN 'Fair' ELSE 'Poor' END AS completeness_level FROM s, k, c""")
def a34(spark, sf):
    return rounded(stats.interpretation(normal_listings(spark, sf)), completeness=4)


_GROUPS = NORMAL_LISTINGS + """
, g AS (SELECT category, count(*) AS n, avg(price) AS mean, var_pop(price) * count(*) AS ss
        FROM priced GROUP BY category)
"""


@query("h01_anova_statistic", _GROUPS + """
, t AS (SELECT count(*) AS k, sum(n) AS total, sum(ss) AS within,
               sum(n * power(mean - (SELECT avg(price) FROM priced), 2)) AS between FROM g)
SELECT round((between / (k - 1)) / (within / (total - k)), 6) AS f_statistic, k - 1 AS df_between,
       CAST(total - k AS BIGINT) AS df_within FROM t""")
def h01_statistic(spark, sf):
    return rounded(hypothesis.anova_statistic(normal_listings(spark, sf)), f_statistic=6)


@query("h01_anova")
def h01(spark, sf):
    return hypothesis.anova(normal_listings(spark, sf))


# p-values by numeric integration of the density, apart from the continued fractions and series they are computed with


def _simpson(density: str, start: str, width: int, source: str, steps: int = 200_000) -> str:
    """SQL: the integral of ``density`` (of x) over ``width`` from ``start``."""
    h = f"({width} / {steps}.0)"
    return f"""(SELECT sum(({density}) * CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {h} / 3
      FROM (SELECT i, {start} + i * {h} AS x, {source}.* FROM range({steps + 1}) r(i), {source}))"""


_F_DENSITY = ("exp(0.5 * (a * ln(a * x) + b * ln(b) - (a + b) * ln(a * x + b)) - ln(x) "
              "- (lgamma(a / 2) + lgamma(b / 2) - lgamma((a + b) / 2)))")  # fmt: skip
_T_DENSITY = "exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(v * pi()) - (v + 1) / 2 * ln(1 + x * x / v))"


@query("h01_anova_p_value", _GROUPS + f"""
, t AS (SELECT count(*) AS k, sum(n) AS total, sum(ss) AS within,
               sum(n * power(mean - (SELECT avg(price) FROM priced), 2)) AS between FROM g),
f AS (SELECT (between / (k - 1)) / (within / (total - k)) AS f, (k - 1)::DOUBLE AS a, (total - k)::DOUBLE AS b FROM t),
p AS (SELECT {_simpson(_F_DENSITY, 'f', 100, 'f')} AS p)
SELECT round(p, 6) AS p_value, p < 0.05 AS significant FROM p""")
def h01_p(spark, sf):
    return rounded(hypothesis.anova(normal_listings(spark, sf)).select("p_value", "significant"), p_value=6)


@query("h02_ttest_p_value", _GROUPS + f"""
, a AS (SELECT * FROM g ORDER BY mean, category LIMIT 1), b AS (SELECT * FROM g ORDER BY mean DESC, category DESC LIMIT 1),
t AS (SELECT abs(a.mean - b.mean) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t, (a.n + b.n - 2)::DOUBLE AS v FROM a, b),
p AS (SELECT 2 * {_simpson(_T_DENSITY, 't', 60, 't')} AS p)
SELECT round(p, 6) AS p_value, p < 0.05 AS significant FROM p""")
def h02_p(spark, sf):
    return rounded(hypothesis.ttest_extremes(normal_listings(spark, sf)).select("p_value", "significant"), p_value=6)


@query("h02_ttest_statistic", _GROUPS + """
, a AS (SELECT * FROM g ORDER BY mean, category LIMIT 1), b AS (SELECT * FROM g ORDER BY mean DESC, category DESC LIMIT 1)
SELECT a.category AS cheapest_category, b.category AS most_expensive_category,
       round(b.mean - a.mean, 4) AS price_difference,
       round((a.mean - b.mean) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS t_statistic,
       a.n + b.n - 2 AS df FROM a, b""")
def h02_statistic(spark, sf):
    return rounded(hypothesis.ttest_statistic(normal_listings(spark, sf)), price_difference=4, t_statistic=6)


@query("h02_ttest_extremes")
def h02(spark, sf):
    return hypothesis.ttest_extremes(normal_listings(spark, sf))


@query("h03_ks_normal")
def h03(spark, sf):
    return hypothesis.ks_normal(normal_activity(spark, sf))


def _ratio_sql(terms, x: str) -> str:
    sides = []
    for side in terms:
        out = repr(side[-1])
        for c in reversed(side[:-1]):
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        sides.append(out)
    return f"({sides[0]} / {sides[1]})"


def _quantile_sql(p: str) -> str:
    middle, tail, far = QUANTILE_TERMS
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_ratio_sql(middle, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} "
            f"WHEN {r} <= 5 THEN sign({p} - 0.5) * {_ratio_sql(tail, f'({r} - 1.6)')} ELSE sign({p} - 0.5) * {_ratio_sql(far, f'({r} - 5)')} END")  # fmt: skip


@query("h03_ks_statistic", NORMAL_ACTIVITY + """
, m AS (SELECT avg(price) AS mu, stddev_samp(price) AS sd, count(*) AS n FROM priced),
z AS (SELECT (price - mu) / sd AS z, row_number() OVER (ORDER BY price) AS i, n FROM priced, m),
t AS (SELECT z, i, n, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
c AS (SELECT i, n, CASE WHEN z < 0 THEN q ELSE 1 - q END AS cdf FROM (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530
      + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS q FROM t))
SELECT round(max(greatest(i / n - cdf, cdf - (i - 1) / n)), 5) AS statistic FROM c""")
def h03_statistic(spark, sf):
    return rounded(hypothesis.ks_normal(normal_activity(spark, sf)).select("statistic"), statistic=5)


@query("h03_ks_p_value", NORMAL_ACTIVITY + """
, m AS (SELECT avg(price) AS mu, stddev_samp(price) AS sd, count(*) AS n FROM priced),
z AS (SELECT (price - mu) / sd AS z, row_number() OVER (ORDER BY price) AS i, n FROM priced, m),
t AS (SELECT z, i, n, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
c AS (SELECT i, n, CASE WHEN z < 0 THEN q ELSE 1 - q END AS cdf FROM (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530
      + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS q FROM t)),
d AS (SELECT max(greatest(i / n - cdf, cdf - (i - 1) / n)) AS d, max(n) AS n FROM c),
p AS (SELECT greatest(0, least(1, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * n * d * d)) FROM range(1, 101) r(k)))) AS p FROM d)
SELECT round(p, 4) AS p_value, p > 0.05 AS is_normal FROM p""")
def h03_p(spark, sf):
    """Against the series of the limit distribution."""
    return rounded(hypothesis.ks_normal(normal_activity(spark, sf)).select("p_value", "is_normal"), p_value=4)


@query("h04_shapiro_statistic", NORMAL_LISTINGS + f"""
, s AS (SELECT venue, price AS x, count(*) OVER (PARTITION BY venue) AS n, row_number() OVER (PARTITION BY venue ORDER BY price) AS i FROM priced),
m AS (SELECT *, {_quantile_sql("((i - 0.375) / (n + 0.25))")} AS m FROM s WHERE n > 5),
e AS (SELECT venue, n, sum(m * m) AS mm, max(m) AS mn, max(CASE WHEN i = n - 1 THEN m END) AS mn1, avg(x) AS mu, 1 / sqrt(n) AS u FROM m GROUP BY venue, n),
a AS (SELECT *, ((((-2.706056 * u + 4.434685) * u - 2.071190) * u - 0.147981) * u + 0.221157) * u + mn / sqrt(mm) AS an,
             ((((-3.582633 * u + 5.682633) * u - 1.752461) * u - 0.293762) * u + 0.042981) * u + mn1 / sqrt(mm) AS an1 FROM e),
f AS (SELECT *, sqrt((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)) AS phi FROM a)
SELECT venue, n, round(power(sum(x * CASE WHEN i = n THEN an WHEN i = 1 THEN -an WHEN i = n - 1 THEN an1 WHEN i = 2 THEN -an1
       ELSE m / phi END), 2) / sum(power(x - mu, 2)), 6) AS statistic FROM m JOIN f USING (venue, n) GROUP BY venue, n""")
def h04_statistic(spark, sf):
    found = hypothesis.shapiro(normal_listings(spark, sf), by="venue").filter("n > 5")
    return rounded(found.select("venue", "n", "statistic"), statistic=6)


@query("h04_shapiro_by_venue")
def h04(spark, sf):
    return hypothesis.shapiro(normal_listings(spark, sf), by="venue")
