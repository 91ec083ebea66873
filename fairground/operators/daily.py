"""Statistics over growing data: one small state row per category and day, merged by later batches.

A state row holds counts, sums, extremes, the counts and sums of each price band, a KLL sketch of the prices and a theta
sketch of the venues. All of them merge, so a batch is reduced on its own, appended as its own folder (a replay replaces
it), and readers add up state rows and never see an event again. Sums, counts, extremes and bands are those of all
events. Quantiles are off by at most ``RANK_ERROR`` of the ranks, with 99 % confidence, and exact up to ``K`` prices.
Distinct counts are exact up to ``2 ** LG`` values of a set; beyond that their standard error is about
``DISTINCT_ERROR``, and that of an intersection or a difference is that share of the union. Rows without a date or
category are kept under null. Sets that must be exact at any size have a log of their own (``add_venues``): the distinct
venues of each category and day, without their events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fairground.functions import dates, text
from fairground.operators.rollups import DAY_LABELS, PRICE_BANDS, top_k
from fairground.sources import versions

K, LG = 800, 12
RANK_ERROR = 2.446 / K**0.9433  # published bound of the sketch for a single rank
DISTINCT_ERROR = 1 / (2 ** (LG / 2))
_BANDS = range(len(PRICE_BANDS))
_SUMS = ("n", "n_priced", "total", *[f"{c}{i}" for i in _BANDS for c in ("band_n", "band_total")])
SCHEMA = (
    "category string, day date, n bigint, n_priced bigint, total double, squares double, low double, high double, "
    + ", ".join(f"band_n{i} bigint, band_total{i} double" for i in _BANDS) + ", prices binary, venues binary"
)


def _band(price: Column, i: int) -> Column:
    low = price > (PRICE_BANDS[i - 1][1] if i else 0.0)
    return low if PRICE_BANDS[i][1] is None else low & (price <= PRICE_BANDS[i][1])


def day_state(df: DataFrame) -> DataFrame:
    """State rows of some events (category, venue, price, date); one shuffle of partial states."""
    p = F.when(F.col("price") > 0, F.col("price").cast("double"))
    bands = [x for i in _BANDS for x in (
        F.count_if(_band(p, i)).alias(f"band_n{i}"), F.coalesce(F.sum(F.when(_band(p, i), p)), F.lit(0.0)).alias(f"band_total{i}"))]
    venue = F.when(~text.blank(F.col("venue")), F.col("venue"))
    return df.groupBy("category", F.col("date").cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.count(p).alias("n_priced"), F.coalesce(F.sum(p), F.lit(0.0)).alias("total"),
        # squares about the group's own mean: no cancellation when they are merged
        F.coalesce(F.var_pop(p) * F.count(p), F.lit(0.0)).alias("squares"), F.min(p).alias("low"), F.max(p).alias("high"),
        *bands, F.kll_sketch_agg_double(p, K).alias("prices"), F.theta_sketch_agg(venue, LG).alias("venues"),
    )


def add_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Reduce a batch of events and append its state; a replay replaces it."""
    versions.write_batch(day_state(df), path, batch_id)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return versions.read_log(spark, path, SCHEMA).drop("batch")


def merged(state: DataFrame, *by: str | Column) -> DataFrame:
    """State rows added up per group (``_g0``, ``_g1``, ...); squares about the group's mean, from those about each
    row's own. Without groups there is one row, without squares."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    names = [f"_g{i}" for i in range(len(keys))]
    rows, squares = state.withColumns(dict(zip(names, keys))) if keys else state, F.lit(None).cast("double")
    if names:
        group = W.partitionBy(*names)
        own = F.try_divide(F.col("total"), F.col("n_priced"))
        whole = F.try_divide(F.sum("total").over(group), F.sum("n_priced").over(group))
        rows = rows.withColumn("_between", F.coalesce(F.col("n_priced") * F.pow(own - whole, 2), F.lit(0.0)))
        squares = F.sum(F.col("squares") + F.col("_between"))
    return rows.groupBy(*names).agg(
        *[F.sum(c).alias(c) for c in _SUMS], squares.alias("squares"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("prices", K).alias("prices"),
        F.theta_union_agg("venues", LG).alias("venues"),
    )


def fold(spark: SparkSession, path: str, target: str) -> None:
    """The state with one row per category and day, as the only batch of a new folder."""
    whole = merged(read_state(spark, path), "category", "day").withColumnsRenamed({"_g0": "category", "_g1": "day"})
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    versions.write_batch(whole.select(*names), target, versions.FOLDED)


def _mean() -> Column:
    return F.coalesce(F.try_divide(F.col("total"), F.col("n_priced")), F.lit(0.0)).alias("avg_price")


def _quantile(p: float) -> Column:
    return F.when(F.col("n_priced") > 0, F.kll_sketch_get_quantile_double("prices", F.lit(p)))


def category_summary(state: DataFrame) -> DataFrame:
    """Per category: n (priced), mean, std (sample), min, q1, median, q3, max."""
    n = F.col("n_priced")
    return merged(state, "category").where(n > 0).select(
        F.col("_g0").alias("category"), n.alias("n"), (F.col("total") / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.try_divide(F.col("squares"), n - 1))).alias("std"), F.col("low").alias("min"),
        _quantile(0.25).alias("q1"), _quantile(0.5).alias("median"), _quantile(0.75).alias("q3"), F.col("high").alias("max"),
    )


def headline(state: DataFrame) -> DataFrame:
    """Total, mean and median price, distinct venues."""
    return merged(state).select(
        F.coalesce("n", F.lit(0)).alias("total_events"), _mean().alias("mean_price"),
        F.coalesce(_quantile(0.5), F.lit(0.0)).alias("median_price"),
        F.coalesce(F.theta_sketch_estimate("venues"), F.lit(0)).alias("total_venues"),
    )


def monthly(state: DataFrame, n: int = 12, latest: bool = False) -> DataFrame:
    months = state.where("day IS NOT NULL").groupBy(dates.month_key(F.col("day")).alias("month")).agg(F.sum("n").alias("n"))
    return top_k(months, n, F.desc("month") if latest else F.asc("month")).orderBy("month")


def weekly(state: DataFrame, n: int = 16) -> DataFrame:
    weeks = merged(state.where("day IS NOT NULL"), dates.week_key(F.col("day"))).select(F.col("_g0").alias("week"), "n", _mean())
    return top_k(weeks, n, F.desc("week")).orderBy("week")


def day_of_week(state: DataFrame) -> DataFrame:
    """All seven days, whether there are events or not."""
    found = merged(state.where("day IS NOT NULL"), F.weekday("day")).select("_g0", "n", _mean())
    names = F.array(*[F.lit(d) for d in DAY_LABELS])
    return state.sparkSession.range(7).join(found, F.col("id") == F.col("_g0"), "left").select(
        F.get(names, F.col("id").cast("int")).alias("day"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"),
    )


def price_bands(state: DataFrame) -> DataFrame:
    """All bands, empty ones too."""
    whole = state.agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in _BANDS for c in ("band_n", "band_total")])
    rows = F.array(*[F.struct(
        F.lit(PRICE_BANDS[i][0]).alias("band"), F.coalesce(f"band_n{i}", F.lit(0)).alias("n"),
        F.coalesce(F.try_divide(F.col(f"band_total{i}"), F.col(f"band_n{i}")), F.lit(0.0)).alias("avg_price")) for i in _BANDS])
    return whole.select(F.inline(rows))


def venue_sets(state: DataFrame, first: Column, second: Column, by: str = "category") -> DataFrame:
    """Distinct venues in two sets of days: either, both, only the first; ``first`` and ``second`` are conditions on ``day``."""
    def side(condition: Column) -> Column:
        return F.theta_union_agg(F.when(condition, F.col("venues")), LG)

    sides = state.groupBy(by).agg(side(first).alias("a"), side(second).alias("b"))
    return sides.select(
        by, F.theta_sketch_estimate(F.theta_union("a", "b", LG)).alias("either"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("both"),
        F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("only_first"),
    )


def day_venues(df: DataFrame) -> DataFrame:
    """Distinct (category, day, venue) of some events; a blank venue is null, and keeps its category known."""
    venue = F.when(~text.blank(F.col("venue")), F.col("venue"))
    return df.select("category", F.col("date").cast("date").alias("day"), venue.alias("venue")).distinct()


def add_venues(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch's venues by day; a replay replaces them."""
    versions.write_batch(day_venues(df), path, batch_id)


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    return versions.read_log(spark, path, "category string, day date, venue string").drop("batch")


def exact_venue_sets(days: DataFrame, first: Column, second: Column, by: str = "category") -> DataFrame:
    """``venue_sets`` from the venues themselves: exact at any size; two shuffles, of which the second is of sums."""
    known = F.col("venue").isNotNull()
    sides = days.groupBy(by, "venue").agg(F.max(F.coalesce(first, F.lit(False)) & known).alias("a"), F.max(F.coalesce(second, F.lit(False)) & known).alias("b"))
    return sides.groupBy(by).agg(
        F.count_if(F.col("a") | F.col("b")).alias("either"), F.count_if(F.col("a") & F.col("b")).alias("both"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_first"),
    )
