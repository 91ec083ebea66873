"""The full analysis report: statistics, distribution, anomalies and normality on one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairground.operators import anomaly, hypothesis, stats


def full_report(df: DataFrame, as_of: Column, pairs: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Rounded report row over an analysis frame. Cache ``df`` first when it is expensive: each part scans it.

    ``pairs`` adds fuzzy duplicates to the anomaly totals. Runs the normality test's jobs.
    """
    summary = stats.price_summary(df, exact)
    counts = stats.distinct_counts(df, "category", "venue")
    shape = stats.price_shape(df, exact)
    quarts = stats.quartiles(df, exact).select("q1", "q3")
    rows = anomaly.anomaly_rows(df, as_of, pairs=pairs, exact=exact)
    rate = anomaly.anomaly_rate(df, rows).select("total_events", "total_anomalies", "anomaly_rate")
    outliers = anomaly.outlier_summary(df, exact).select("total_outliers")
    normal = hypothesis.ks_normal(df).agg(
        F.coalesce(F.first("is_normal"), F.lit(False)).alias("is_normal"), F.first("conclusion").alias("conclusion")
    )
    wide = stats.one_row(rate, summary, counts, shape.drop("range"), quarts, outliers, normal)

    def r(name: str, digits: int = 2) -> Column:
        return F.bround(F.col(name), digits)

    return wide.select(
        "total_events", r("mean").alias("mean_price"), r("median").alias("median_price"), r("std").alias("std_dev"),
        r("min").alias("min_price"), r("max").alias("max_price"), F.col("n_category").alias("total_categories"),
        F.col("n_venue").alias("total_venues"), "shape", r("skewness", 3).alias("skewness"),
        r("kurtosis", 3).alias("kurtosis"), r("q1").alias("q1"), r("q3").alias("q3"), r("iqr").alias("iqr"),
        "total_anomalies", r("anomaly_rate").alias("anomaly_rate"), F.col("total_outliers").alias("price_outliers"),
        "is_normal", "conclusion",
    )
