"""Dashboard roll-ups, top-k lists and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fairground.functions import dates, text
from fairground.operators.filters import specific_category
from fairground.operators.normalize import display_card, priced, short_title
from fairground.operators.ranks import quantiles
from fairground.operators.relations import with_summary
from fairground.operators.stats import QUARTILES, beside_quantiles, category_stats, one_row, share

DAY_LABELS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

# Upper edges of the dashboard's price bands.
PRICE_BANDS = (("Budget", 300.0), ("Mid-Range", 800.0), ("Premium", 2000.0), ("Luxury", None))


def headline(df: DataFrame, exact: bool = True) -> DataFrame:
    """Total, mean and median price, distinct venues; zeros for an empty frame. Takes raw (nullable) columns."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(F.avg(F.when(F.col("price") > 0, F.col("price"))), F.lit(0.0)).alias("mean_price"),
    )
    venues = df.filter(~text.blank(F.col("venue"))).select("venue").distinct().agg(
        F.count(F.lit(1)).alias("total_venues")
    )
    median = quantiles(priced(df), "price", {"m": 0.5}, exact=exact).agg(
        F.coalesce(F.max("m"), F.lit(0.0)).alias("median_price")
    )
    return one_row(totals, venues, median)


def top_k(df: DataFrame, k: int, *order: Column, by: str | None = None) -> DataFrame:
    """First ``k`` rows by ``order``, overall or per group. Only k rows per task leave the map side either way."""
    if by is None:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values; ties by value."""
    counts = df.filter(~text.blank(F.col(column))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, k, F.desc("n"), F.asc(column))


def mean_price_by_category(df: DataFrame, k: int = 10) -> DataFrame:
    """Mean price cut to an integer, highest first."""
    rows = priced(df).filter(~text.blank(F.col("category"))).groupBy("category")
    return top_k(rows.agg(F.avg("price").cast("int").alias("price")), k, F.desc("price"), F.asc("category"))


def five_numbers(df: DataFrame, exact: bool = True) -> DataFrame:
    rows = priced(df)
    extremes = rows.agg(F.min("price").alias("min"), F.max("price").alias("max"))
    return one_row(extremes, quantiles(rows, "price", QUARTILES, exact=exact)).select("min", "q1", "median", "q3", "max")


def price_sample(df: DataFrame, size: int = 500, seed: int | None = None) -> DataFrame:
    """Uniform sample without replacement of at most ``size`` prices (a chart feature, not a shortcut)."""
    return priced(df).select("price").orderBy(F.rand(seed)).limit(size)


def category_detail(df: DataFrame, exact: bool = True) -> DataFrame:
    """Category table of the dashboard, rounded, undefined numbers shown as 0."""

    def safe(c: str) -> Column:
        return F.bround(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)), 2)

    return category_stats(df, exact).select(
        F.col("category").alias("name"), "n",
        safe("mean").alias("mean_price"), safe("median").alias("median_price"),
        safe("q1").alias("q1"), safe("q3").alias("q3"), safe("std").alias("std_dev"),
    ).orderBy(F.desc("n"), "name")


def monthly(df: DataFrame, n: int = 12, latest: bool = False) -> DataFrame:
    """Events per month, the first ``n`` months (or the latest), ascending."""
    counts = df.filter(F.col("date").isNotNull()).groupBy(dates.month_key(F.col("date")).alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return top_k(counts, n, F.desc("month") if latest else F.asc("month")).orderBy("month")


def _mean_priced() -> Column:
    return F.coalesce(F.avg(F.when(F.col("price") > 0, F.col("price"))), F.lit(0.0))


def weekly(df: DataFrame, n: int = 16) -> DataFrame:
    """Events and mean price of the last ``n`` weeks present."""
    weeks = df.filter(F.col("date").isNotNull()).groupBy(dates.week_key(F.col("date")).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), _mean_priced().alias("avg_price")
    )
    return top_k(weeks, n, F.desc("week")).orderBy("week")


def _spine(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("_i"))


def day_of_week(df: DataFrame) -> DataFrame:
    """Events and mean price per weekday, all seven days present."""
    rows = df.filter(F.col("date").isNotNull()).groupBy(F.weekday("date").alias("_i")).agg(
        F.count(F.lit(1)).alias("n"), _mean_priced().alias("avg_price")
    )
    names = F.array(*[F.lit(d) for d in DAY_LABELS])
    return _spine(df.sparkSession, 7).join(rows, "_i", "left").select(
        F.get(names, F.col("_i")).alias("day"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"),
    )


def price_bands(df: DataFrame, bands: Sequence[tuple[str, float | None]] = PRICE_BANDS) -> DataFrame:
    """Events and mean price per fixed band, empty bands present."""
    band = F.lit(len(bands) - 1)
    for i in range(len(bands) - 2, -1, -1):
        band = F.when(F.col("price") <= bands[i][1], F.lit(i)).otherwise(band)
    rows = priced(df).groupBy(band.alias("_i")).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("avg_price"))
    names = F.array(*[F.lit(name) for name, _ in bands])
    return _spine(df.sparkSession, len(bands)).join(rows, "_i", "left").select(
        F.get(names, F.col("_i")).alias("band"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"),
    )


def top_category_prices(df: DataFrame, k: int = 10, exact: bool = True) -> DataFrame:
    """Price statistics of the ``k`` largest categories; the deviation is the population one."""
    rows = priced(df).filter(~text.blank(F.col("category")))
    stats = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"), F.stddev_pop("price").alias("std"),
        F.min("price").alias("min"), F.max("price").alias("max"),
    )
    top = top_k(stats, k, F.desc("n"), F.asc("category"))
    medians = quantiles(rows.join(top.select("category"), "category", "left_semi"), "price", {"median": 0.5},
                        ["category"], exact)
    return beside_quantiles(top, medians, ["category"])


def top_category_means(df: DataFrame, k: int = 8) -> DataFrame:
    """Mean price of the ``k`` most frequent categories, highest first."""
    top = top_values(df, "category", k)
    means = priced(df).join(top.select("category"), "category", "left_semi").groupBy("category")
    return means.agg(F.avg("price").alias("mean_price")).orderBy(F.desc("mean_price"))


def progress(events: DataFrame, summary: DataFrame) -> DataFrame:
    """Totals, shares and what remains; one row. ``date`` may be text or timestamp."""
    e = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(~text.blank(F.col("date").cast("string"))).alias("events_with_dates"),
        F.count_if(specific_category(F.col("category"))).alias("events_with_categories"),
    )
    s = summary.agg(F.count(F.lit(1)).alias("total_summaries"))
    total = F.col("total_events")

    def pct(name: str) -> Column:
        return F.coalesce(F.bround(share(F.col(name), total), 1), F.lit(0.0))

    return one_row(e, s).select(
        "*",
        pct("total_summaries").alias("summary_pct"),
        pct("events_with_dates").alias("date_pct"),
        pct("events_with_categories").alias("category_pct"),
        (total - F.col("total_summaries")).alias("remaining"),
    )


def gauge(anomaly_rate: Column) -> Column:
    """Quality gauge 100 - rate, rounded half up."""
    return F.floor(100 - anomaly_rate + F.lit(0.5)).cast("int")


def featured(events: DataFrame, summary: DataFrame, k: int = 3, low: float = 400, high: float = 700) -> DataFrame:
    """Cheapest, dearest, and best-scored mid-priced events that have a summary: (bucket, card columns)."""
    joined = with_summary(events, summary)
    price, quality = F.col("price"), F.col("quality_score")
    picks = {
        "cheapest": (price > 0, F.asc("price")),
        "medium": (price.between(low, high), F.desc("quality_score")),
        "premium": (price > 0, F.desc("price")),
    }
    out = None
    for name, (keep, order) in picks.items():
        best = top_k(joined.filter(keep), k, order, F.asc("uuid"))
        part = display_card(best).select(F.lit(name).alias("bucket"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def scatter(events: DataFrame, summary: DataFrame, n: int = 500) -> DataFrame:
    """Up to ``n`` (price, quality, category) chart points of priced, scored events."""
    joined = with_summary(events, summary).filter((F.col("price") > 0) & F.col("quality_score").isNotNull())
    return top_k(joined, n, F.asc("uuid")).select(
        "price", F.col("quality_score").cast("int").alias("quality"),
        text.or_default(F.col("category"), "Other").alias("category"),
    )


def latest_summaries(events: DataFrame, summary: DataFrame, n: int = 3) -> DataFrame:
    """Latest distinct (title, score, category), titles cut to 50 characters for display."""
    joined = with_summary(events, summary)
    groups = joined.groupBy("title", "quality_score", "category").agg(F.max("updated_at").alias("updated_at"))
    last = top_k(groups, n, F.desc("updated_at"), F.asc("title"), F.asc("quality_score"), F.asc("category"))
    return last.select(short_title(F.col("title")).alias("title"), "quality_score", "category")


def pie_shares(df: DataFrame, k: int = 6) -> DataFrame:
    """Share of each of the ``k`` largest specific categories within those shown."""
    top = top_values(df.filter(specific_category(F.col("category"))), "category", k)
    return top.withColumn("pct", F.col("n") / F.sum("n").over(W.partitionBy()) * 100)  # at most k rows


def last_n(df: DataFrame, n: int, order: str, by: str | None = None, tie: str | None = None) -> DataFrame:
    """Last ``n`` rows (per group)."""
    keys = [F.desc(order)] + ([F.desc(tie)] if tie else [])
    return top_k(df, n, *keys, by=by)


def rate(snapshots: DataFrame, counter: str, n: int = 5, ts: str = "ts") -> DataFrame:
    """Per-minute rate between the oldest and newest of the last ``n`` snapshots; 0 without time difference."""
    recent = snapshots.orderBy(F.desc(ts)).limit(n)
    spread = recent.agg(
        F.count(F.lit(1)).alias("_n"),
        (F.max(ts).cast("double") - F.min(ts).cast("double")).alias("_s"),
        (F.max_by(counter, ts) - F.min_by(counter, ts)).alias("_d"),
    )
    value = F.when(F.col("_s") > 0, F.round(F.col("_d") / F.col("_s") * 60, 1)).otherwise(F.lit(0.0))
    return spread.select(F.when(F.col("_n") >= 2, value).alias("per_minute"))


def rolling_rate(snapshots: DataFrame, counter: str, by: str, n: int = 5, ts: str = "ts") -> DataFrame:
    """The same rate at every snapshot of each series."""
    w = W.partitionBy(by).orderBy(ts).rowsBetween(-(n - 1), 0)
    seconds = F.col(ts).cast("double") - F.first(F.col(ts).cast("double")).over(w)
    gained = F.col(counter) - F.first(counter).over(w)
    value = F.when(seconds > 0, gained / seconds * 60).otherwise(F.lit(0.0))
    return snapshots.withColumn("per_minute", F.when(F.count(F.lit(1)).over(w) >= 2, value))


def eta_text(remaining: Column, per_minute: Column) -> Column:
    """'~12 min' or '~2h 5m'; null without work or progress."""
    minutes = remaining / per_minute
    hours = F.floor(minutes / 60)
    rest = F.floor(minutes - hours * 60 + F.lit(0.5))
    long = F.format_string("~%dh %dm", hours, rest)
    short = F.format_string("~%d min", F.ceil(minutes))
    return F.when((per_minute > 0) & (remaining > 0), F.when(minutes < 60, short).otherwise(long))
