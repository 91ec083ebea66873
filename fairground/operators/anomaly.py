"""Anomaly and data-quality detectors over an analysis frame.

Each detector yields rows (uuid, title, type, severity, reason); counts, shares and scores are aggregates of all of
those rows or of the frame. Only ``reported_rows`` shortens: it gives the first few rows of each kind for a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairground.functions import labels, text
from fairground.operators.normalize import priced
from fairground.operators.ranks import quantiles
from fairground.operators.stats import one_row, share

# Categories where a free event is ordinary, and the reasons' wording.
FREE_CATEGORIES = ("seminar", "workshop", "conference")


def _one(df: DataFrame) -> dict[str, Column]:
    """A frame of one row (a handful of numbers) as literals."""
    row = df.first()
    kinds = dict(df.dtypes)
    return {c: F.lit(row[c]).cast(kinds[c]) for c in df.columns}


def price_bounds(df: DataFrame, exact: bool = True) -> dict[str, Column]:
    """What the three outlier rules need, computed once: quartile fences, moments, median and MAD as literals.

    Runs its jobs when called. Plans that use the bounds many times stay small, and filters on them reach the scan.
    """
    rows = priced(df)
    b = _one(quantiles(rows, "price", {"q1": 0.25, "median": 0.5, "q3": 0.75}, exact=exact))
    b |= _one(rows.agg(
        F.avg("price").alias("mean"), F.stddev_pop("price").alias("std_pop"), F.stddev_samp("price").alias("std_samp")
    ))
    b |= _one(quantiles(rows.select(F.abs(F.col("price") - b["median"]).alias("d")), "d", {"mad": 0.5}, exact=exact))
    iqr = b["q3"] - b["q1"]
    return b | {"lower": b["q1"] - 1.5 * iqr, "upper": b["q3"] + 1.5 * iqr, "far": b["q3"] + 3 * iqr}


def _outlier_flags(b: dict[str, Column]) -> dict[str, Column]:
    p = F.col("price")
    modified = F.when(b["mad"] == 0, p != b["median"]).otherwise(
        F.abs(F.try_divide(0.6745 * (p - b["median"]), b["mad"])) > 3.5
    )
    return {
        "iqr_outlier": (p < b["lower"]) | (p > b["upper"]),
        "z_outlier": F.coalesce(F.abs(F.try_divide(p - b["mean"], b["std_pop"])) > 3, F.lit(False)),
        "mad_outlier": F.coalesce(modified, F.lit(False)),
    }


def _outlier_severity(b: dict[str, Column]) -> Column:
    return F.when(F.col("price") > b["far"], "high").otherwise("medium")


def flag_outliers(df: DataFrame, exact: bool = True) -> DataFrame:
    """Priced rows with ``iqr_outlier``, ``z_outlier``, ``mad_outlier`` and their union ``outlier``.

    With MAD = 0 every price off the median is an outlier of the third rule.
    """
    b = price_bounds(df, exact)
    p = F.col("price")
    rows = priced(df).withColumns(_outlier_flags(b))
    return rows.withColumns({
        "outlier": F.col("iqr_outlier") | F.col("z_outlier") | F.col("mad_outlier"),
        "z_score": F.try_divide(p - b["mean"], b["std_samp"]),
        "expensive": p > b["upper"],
        "cheap": p < b["lower"],
        "outlier_severity": _outlier_severity(b),
        "q3": b["q3"],
    })


def iqr_outliers(df: DataFrame, width: float = 1.5, exact: bool = True) -> DataFrame:
    """Priced rows beyond the quartile fences alone."""
    quarts = quantiles(priced(df), "price", {"q1": 0.25, "q3": 0.75}, exact=exact)
    iqr = F.col("q3") - F.col("q1")
    fences = quarts.select(F.struct((F.col("q1") - width * iqr).alias("lo"), (F.col("q3") + width * iqr).alias("hi")))
    rows = priced(df).withColumn("_b", fences.scalar())
    return rows.filter((F.col("price") < F.col("_b.lo")) | (F.col("price") > F.col("_b.hi"))).drop("_b")


def z_outliers(df: DataFrame, limit: float = 3.0) -> DataFrame:
    """Priced rows more than ``limit`` population deviations from the mean."""
    moments = priced(df).agg(F.struct(F.avg("price").alias("mu"), F.stddev_pop("price").alias("sd")).alias("m"))
    rows = priced(df).withColumn("_m", moments.scalar())
    z = F.abs(F.try_divide(F.col("price") - F.col("_m.mu"), F.col("_m.sd")))
    return rows.filter(z > limit).drop("_m")


def outlier_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    flags = flag_outliers(df, exact)
    n = F.count_if("outlier")
    return flags.agg(
        n.alias("total_outliers"),
        share(n, F.count(F.lit(1))).alias("percentage"),
        F.count_if("iqr_outlier").alias("iqr_method"),
        F.count_if("z_outlier").alias("z_score_method"),
        F.count_if("mad_outlier").alias("modified_z_score_method"),
        F.count_if(F.col("outlier") & F.col("expensive")).alias("n_expensive"),
        F.count_if(F.col("outlier") & F.col("cheap")).alias("n_cheap"),
    )


def extreme_outliers(df: DataFrame, k: int = 10, exact: bool = True) -> DataFrame:
    """The ``k`` dearest and ``k`` cheapest outliers, with the sample z-score."""
    flags = flag_outliers(df, exact).filter("outlier")
    columns = ["uuid", "title", "price", "category", "venue", "z_score"]
    dear = flags.filter("expensive").orderBy(F.desc("price"), "uuid").limit(k)
    cheap = flags.filter("cheap").orderBy(F.asc("price"), "uuid").limit(k)
    return dear.select(F.lit("expensive").alias("side"), *columns).unionByName(
        cheap.select(F.lit("cheap").alias("side"), *columns)
    )


# A detector: (type, condition, severity, reason). All detectors can thus run in one pass over the frame.
Detector = tuple[str, Column, Column, Column]


def _expensive(b: dict[str, Column]) -> Detector:
    flags = list(_outlier_flags(b).values())
    found = F.col("price").isNotNull() & (F.col("price") > b["upper"]) & (flags[0] | flags[1] | flags[2])
    reason = F.format_string("Price %.2f TL significantly higher than typical (Q3: %.2f TL)", F.col("price"), b["q3"])
    return "price_outlier_expensive", found, _outlier_severity(b), reason


def _round_price() -> Detector:
    p = F.col("price")
    reason = F.format_string("Price is a suspiciously round number (%.0f TL)", "price")
    return "suspiciously_round_price", (p >= 1000) & (p % 1000 == 0), F.lit("low"), reason


def _free_in_paid() -> Detector:
    found = (F.col("price") == 0) & ~F.col("category").isin(*FREE_CATEGORIES)
    reason = F.format_string("Free event in typically paid category (%s)", "category")
    return "free_event_in_paid_category", found, F.lit("low"), reason


def _temporal(as_of: Column) -> list[Detector]:
    ts = F.col("date")
    day, clock = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm")
    return [
        ("past_event", _past(ts, as_of), F.lit("medium"), F.format_string("Event date is in the past (%s)", day)),
        ("far_future_event", _far_future(ts, as_of), F.lit("low"),
         F.format_string("Event is more than 1 year in the future (%s)", day)),
        ("unusual_time", _odd_hour(ts), F.lit("low"), F.format_string("Event scheduled at unusual hour (%s)", clock)),
    ]


def _no_description() -> Detector:
    return "missing_description", F.col("description_length") == 0, F.lit("medium"), F.lit("Event has no description")


def detect(df: DataFrame, *detectors: Detector) -> DataFrame:
    """The rows of all ``detectors`` in one pass: (uuid, title, type, severity, reason)."""
    found = [
        F.when(keep, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), reason.alias("reason")))
        for kind, keep, severity, reason in detectors
    ]
    return df.select("uuid", "title", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def expensive_rows(df: DataFrame, exact: bool = True) -> DataFrame:
    return detect(df, _expensive(price_bounds(df, exact)))


def round_price_rows(df: DataFrame) -> DataFrame:
    return detect(df, _round_price())


def is_psychological(price: Column) -> Column:
    """Cents are .00 or .99."""
    return F.bround(price % 1 * 100).isin(0, 99)


def psychological_pricing(df: DataFrame) -> DataFrame:
    n = F.count_if(is_psychological(F.col("price")))
    return priced(df).agg(n.alias("n"), share(n, F.count(F.lit(1))).alias("percentage"))


def free_in_paid_rows(df: DataFrame) -> DataFrame:
    return detect(df, _free_in_paid())


def _past(ts: Column, as_of: Column) -> Column:
    return ts < as_of


def _far_future(ts: Column, as_of: Column) -> Column:
    return ts > as_of + F.expr("interval 365 days")


def _odd_hour(ts: Column) -> Column:
    return F.hour(ts).between(3, 6)


def temporal_rows(df: DataFrame, as_of: Column) -> DataFrame:
    """Past, far-future (more than 365 days ahead) and odd-hour (03..06) events."""
    return detect(df, *_temporal(as_of))


def temporal_summary(df: DataFrame, as_of: Column) -> DataFrame:
    ts = F.col("date")
    dated = F.count("date")
    past = F.count_if(_past(ts, as_of))
    return df.agg(
        past.alias("n_past"),
        share(past, dated).alias("pct_past"),
        F.count_if(_far_future(ts, as_of)).alias("n_far_future"),
        F.count_if(_odd_hour(ts)).alias("n_unusual"),
    )


def _missing(name: str) -> Column:
    return (F.col(name) == "unknown") | (F.col(name) == "")


def _quality_counts() -> dict[str, Column]:
    length = F.col("description_length")
    return {
        "missing_description": F.count_if(length == 0),
        "short_description": F.count_if((length > 0) & (length < 50)),
        "missing_venue": F.count_if(_missing("venue")),
        "missing_category": F.count_if(_missing("category")),
        "missing_date": F.count_if(F.col("date").isNull()),
    }


def quality(df: DataFrame) -> DataFrame:
    """Missing and short fields: (issue, n, pct), one pass."""
    counts = _quality_counts()
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[c.alias(n) for n, c in counts.items()])
    items = [F.struct(F.lit(n).alias("issue"), F.col(n).alias("n"), share(F.col(n), F.col("total")).alias("pct")) for n in counts]
    return wide.select(F.inline(F.array(*items)))


def completeness(df: DataFrame) -> DataFrame:
    """100 minus the share of missing descriptions, venues, categories and dates."""
    counts = _quality_counts()
    gaps = sum((counts[k] for k in ("missing_venue", "missing_category", "missing_date")), counts["missing_description"])
    return df.agg((100 - share(gaps, F.count(F.lit(1)) * 4)).alias("completeness"))


def missing_description_rows(df: DataFrame) -> DataFrame:
    return detect(df, _no_description())


def single_event_venues(df: DataFrame) -> DataFrame:
    venues = df.groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    n = F.count_if(F.col("n") == 1)
    return venues.agg(n.alias("n"), share(n, F.count(F.lit(1))).alias("percentage"))


def high_variance_venues(df: DataFrame, k: int | None = 10, min_events: int = 5, ratio: float = 1.0) -> DataFrame:
    """Venues whose price deviation exceeds their mean, by deviation."""
    stats = priced(df).groupBy("venue").agg(
        F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("std_dev"), F.count(F.lit(1)).alias("n")
    )
    odd = stats.filter((F.col("std_dev") / F.col("mean_price") > ratio) & (F.col("n") >= min_events))
    odd = odd.withColumn("cv", F.col("std_dev") / F.col("mean_price") * 100)
    return odd if k is None else odd.orderBy(F.desc("std_dev"), "venue").limit(k)


def union_rows(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def duplicate_rows(pairs: DataFrame) -> DataFrame:
    """Pairs of ``linkage.duplicate_pairs`` as anomaly rows. They name no single event, so uuid is null."""
    pct = F.format_string("Highly similar titles (%.1f%% match) at same venue on same date", F.col("similarity") * 100)
    return pairs.select(
        F.lit(None).cast("string").alias("uuid"), F.col("title_a").alias("title"),
        F.lit("potential_duplicate").alias("type"),
        F.when(F.col("similarity") > 0.95, "high").otherwise("medium").alias("severity"), pct.alias("reason"),
    )


def anomaly_rows(df: DataFrame, as_of: Column, pairs: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """All detectors' rows, all of them, in one pass over ``df``. Pass ``pairs`` to include fuzzy duplicates."""
    bounds = price_bounds(df, exact)
    rows = detect(df, _expensive(bounds), _round_price(), _free_in_paid(), *_temporal(as_of), _no_description())
    rows = rows.withColumn("uuid", F.col("uuid").cast("string"))
    return rows if pairs is None else union_rows(rows, duplicate_rows(pairs))


def reported_rows(rows: DataFrame, n: int = 20) -> DataFrame:
    """For a list: the first ``n`` rows of each type by key. Nothing is counted or scored from these."""
    first = F.row_number().over(Window.partitionBy("type").orderBy("uuid", "title"))
    return rows.withColumn("_nth", first).where(F.col("_nth") <= n).drop("_nth")


def anomaly_counts(rows: DataFrame) -> DataFrame:
    """Totals by type and severity."""
    return rows.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


def anomaly_rate(df: DataFrame, rows: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("total_events"))
    found = rows.agg(F.count(F.lit(1)).alias("total_anomalies"))
    rate = F.coalesce(share(F.col("total_anomalies"), F.col("total_events")), F.lit(0.0))
    return one_row(total, found).withColumn("anomaly_rate", rate)


def top_anomalies(rows: DataFrame, k: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(labels.severity_rank(F.col("severity"))), F.asc_nulls_last("uuid"), "type").limit(k)


def anomaly_score(df: DataFrame, rows: DataFrame) -> DataFrame:
    """0..100 per event: severity weights summed, capped at 100; 0 without anomalies."""
    weights = rows.filter(F.col("uuid").isNotNull()).groupBy("uuid").agg(
        F.least(F.sum(labels.severity_weight(F.col("severity"))), F.lit(100)).alias("score")
    )
    events = df.select(F.col("uuid").cast("string").alias("uuid"))
    return events.join(weights, "uuid", "left").select("uuid", F.coalesce("score", F.lit(0)).alias("score"))


def integrity_checks(df: DataFrame, duplicate_sets: DataFrame, default_price: float = 250.0) -> DataFrame:
    """Raw-table checks as rows (check, n, failed); ``date`` and ``price`` as stored."""
    price = F.col("price")
    wide = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(text.blank(F.col("title"))).alias("missing_title"),
        F.count_if(text.blank(F.col("date").cast("string"))).alias("missing_date"),
        F.count_if(text.blank(F.col("url"))).alias("missing_url"),
        F.count_if(price.isNotNull()).alias("priced"),
        F.count_if(price.isNull()).alias("missing_price"),
        F.count_if(price == 0).alias("zero_price"),
        F.count_if(price == default_price).alias("default_price"),
        F.count_if(F.length("title") < 3).alias("short_title"),
    )
    wide = one_row(wide, duplicate_sets.agg(F.count(F.lit(1)).alias("duplicate_sets")))
    fails = {
        "missing_title": F.col("missing_title") > 0,
        "missing_date": F.col("missing_date") > 0,
        "missing_url": F.col("missing_url") > 0,
        "priced": (F.col("priced") == 0) & (F.col("total") > 0),
        "missing_price": F.lit(False),
        "zero_price": F.lit(False),
        "default_price": F.lit(False),
        "mostly_unpriced": F.lit(False),
        "short_title": F.col("short_title") > 0,
        "duplicate_sets": F.col("duplicate_sets") > 0,
    }
    wide = wide.withColumn("mostly_unpriced", (F.col("missing_price") > F.col("total") * 0.5).cast("long"))
    items = [
        F.struct(F.lit(k).alias("check"), F.col(k).cast("long").alias("n"), bad.alias("failed"))
        for k, bad in fails.items()
    ]
    return wide.select(F.inline(F.array(*items)))


def passed(checks: DataFrame) -> DataFrame:
    return checks.agg((F.count_if("failed") == 0).alias("passed"))
