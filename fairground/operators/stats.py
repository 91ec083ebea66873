"""Descriptive statistics of an analysis frame (see ``normalize_events``)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from fairground.functions import labels
from fairground.operators.normalize import priced
from fairground.operators.ranks import quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
PERCENTILES = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
FEATURES = ("price", "description_length", "month", "day_of_week", "hour")


def share(part: Column, whole: Column) -> Column:
    """Percentage, null when the whole is zero."""
    return F.try_divide(part * 100.0, whole)


def one_row(*frames: DataFrame) -> DataFrame:
    """Place one-row frames side by side: their union has each column set in one row only, so one aggregate folds it.

    The branches run in parallel in one job. A frame without its row leaves its columns null.
    """
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return together.agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns])


def beside_quantiles(stats: DataFrame, quants: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join grouped aggregates with grouped quantiles (both one row per group)."""
    return stats.join(quants, list(by), "left") if by else one_row(stats, quants)


def price_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    p = F.col("price")
    stats = priced(df).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mean"),
        F.stddev_samp(p).alias("std"),
        F.var_samp(p).alias("variance"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        share(F.stddev_samp(p), F.avg(p)).alias("cv"),
    )
    return one_row(stats, quantiles(priced(df), "price", {"median": 0.5}, exact=exact))


def free_share(df: DataFrame) -> DataFrame:
    free = F.count_if(F.col("price") == 0)
    return df.agg(free.alias("n_free"), share(free, F.count(F.lit(1))).alias("pct_free"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, for several columns in one pass: (field, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    rows = df.select(pairs.alias("_p")).select("_p.*")
    return rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, *columns: str, exact: bool = True) -> DataFrame:
    if not exact:
        return df.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    # Distinct values are taken per (field, value) first, so no task sees one column's full value set.
    values = value_counts(df, *columns).groupBy("field").agg(F.count("value").alias("n"))
    return values.agg(*[F.max(F.when(F.col("field") == c, F.col("n"))).alias(f"n_{c}") for c in columns])


def description_quality(df: DataFrame) -> DataFrame:
    n = F.count_if("has_description")
    return df.agg(
        n.alias("n_described"),
        share(n, F.count(F.lit(1))).alias("pct_described"),
        F.avg("description_length").alias("avg_length"),
    )


def price_shape(df: DataFrame, exact: bool = True) -> DataFrame:
    p = F.col("price")
    stats = priced(df).agg(
        F.skewness(p).alias("skewness"),
        F.kurtosis(p).alias("kurtosis"),
        (F.max(p) - F.min(p)).alias("range"),
    )
    quarts = quantiles(priced(df), "price", {"q1": 0.25, "q3": 0.75}, exact=exact)
    return one_row(stats, quarts).select(
        "skewness",
        "kurtosis",
        labels.shape(F.col("skewness")).alias("shape"),
        labels.tails(F.col("kurtosis")).alias("tails"),
        "range",
        (F.col("q3") - F.col("q1")).alias("iqr"),
    )


def modes(df: DataFrame) -> DataFrame:
    """All most frequent prices, ascending."""
    counts = priced(df).groupBy("price").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") == counts.agg(F.max("n")).scalar()).orderBy("price")


def _fences(quarts: DataFrame, width: float = 1.5) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return quarts.withColumns({
        "iqr": iqr,
        "lower_fence": F.col("q1") - width * iqr,
        "upper_fence": F.col("q3") + width * iqr,
    })


def quartiles(df: DataFrame, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers clipped to the data, outlier count and share, percentiles; one row."""
    fenced = _fences(quantiles(priced(df), "price", {**QUARTILES, **PERCENTILES}, exact=exact))
    bounds = F.struct("lower_fence", "upper_fence").alias("b")
    rows = priced(df).select("price", F.lit(0).alias("_")).withColumn("_b", fenced.select(bounds).scalar())
    p = F.col("price")
    outside = F.count_if((p < F.col("_b.lower_fence")) | (p > F.col("_b.upper_fence")))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        outside.alias("n_outliers"),
        share(outside, F.count(F.lit(1))).alias("pct_outliers"),
        F.min(p).alias("_min"),
        F.max(p).alias("_max"),
    )
    return one_row(stats, fenced).select(
        "q1", "median", "q3", "iqr",
        F.greatest("_min", "lower_fence").alias("lower_whisker"),
        F.least("_max", "upper_fence").alias("upper_whisker"),
        "n_outliers", "pct_outliers", *PERCENTILES,
    )


def outlier_values(df: DataFrame, exact: bool = True) -> DataFrame:
    """Prices beyond the 1.5 IQR fences, ascending."""
    fenced = _fences(quantiles(priced(df), "price", {"q1": 0.25, "q3": 0.75}, exact=exact))
    rows = priced(df).withColumn("_b", fenced.select(F.struct("lower_fence", "upper_fence").alias("b")).scalar())
    p = F.col("price")
    return rows.filter((p < F.col("_b.lower_fence")) | (p > F.col("_b.upper_fence"))).select("price").orderBy("price")


def box_plot(df: DataFrame, by: str | None = None, category: str | None = None, exact: bool = True) -> DataFrame:
    """Five numbers, clipped whiskers, mean and the number of values outside the clipped whiskers."""
    keys = [by] if by else []
    rows = priced(df if category is None else df.filter(F.col("category") == category))
    p = F.col("price")
    stats = rows.groupBy(*keys).agg(F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"))
    fenced = _fences(beside_quantiles(stats, quantiles(rows, "price", QUARTILES, keys, exact), keys))
    whiskers = fenced.select(
        *keys, "min", "q1", "median", "q3", "max", "mean",
        F.greatest("min", "lower_fence").alias("lower_whisker"),
        F.least("max", "upper_fence").alias("upper_whisker"),
    )
    bounds = whiskers.select(*keys, "lower_whisker", "upper_whisker")
    if by:
        tested = rows.join(bounds, by)
    else:
        tested = rows.withColumn("_b", bounds.select(F.struct("*").alias("b")).scalar()).select("price", "_b.*")
    outside = F.count_if((p < F.col("lower_whisker")) | (p > F.col("upper_whisker"))).alias("n_outliers")
    counts = tested.groupBy(*keys).agg(outside)
    return whiskers.join(counts, by) if by else one_row(whiskers, counts)


def category_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation and quartiles of the price per category (null deviation for one row)."""
    rows = priced(df)
    stats = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("std")
    )
    return beside_quantiles(stats, quantiles(rows, "price", QUARTILES, ["category"], exact), ["category"])


def temporal_counts(df: DataFrame) -> DataFrame:
    """Events per month, weekday (Monday = 0) and hour in one pass: (part, key, n)."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(c).alias("part"), F.col(c).alias("key")) for c in ("month", "day_of_week", "hour")
    ]))
    rows = df.filter(F.col("date").isNotNull()).select(parts.alias("_p")).select("_p.*")
    return rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))


def busiest(df: DataFrame) -> DataFrame:
    """Busiest month and weekday; ties go to the earlier one."""
    counts = temporal_counts(df)

    def top(part: str) -> Column:
        here = F.col("part") == part
        return F.max_by(F.when(here, F.col("key")), F.when(here, F.struct("n", -F.col("key"))))

    names = F.array(*[F.lit(d) for d in DAYS])
    return counts.agg(top("month").alias("busiest_month"), F.get(names, top("day_of_week")).alias("busiest_day"))


def correlations(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Pearson r of every feature pair over rows complete in all features: (variable_1, variable_2, r, strength)."""
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna()
    pairs = list(combinations(features, 2))
    wide = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    structs = [
        F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), F.col(f"{a}|{b}").alias("r"))
        for a, b in pairs
    ]
    tall = wide.select(F.inline(F.array(*structs)))
    return tall.withColumn("strength", labels.correlation_strength(F.col("r")))


def strong_correlations(df: DataFrame, features: Sequence[str] = FEATURES, above: float = 0.3) -> DataFrame:
    return correlations(df, features).filter(F.abs("r") > above)


def interpretation(df: DataFrame) -> DataFrame:
    """Report wording levels for variability, skewness and completeness; one row."""
    from fairground.operators.anomaly import completeness

    rows = priced(df).agg(
        labels.variability(share(F.stddev_samp("price"), F.avg("price"))).alias("variability"),
        labels.skew_level(F.skewness("price")).alias("skew"),
    )
    return one_row(rows, completeness(df)).withColumn(
        "completeness_level", labels.completeness_level(F.col("completeness"))
    )
