"""Descriptive statistics, tests and detectors on small frames, including the degenerate ones."""

import functools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fairground.operators import anomaly, hypothesis, rollups, stats
from fairground.operators.normalize import accepted, collapse_nulls, normalize_events, rejected, validate_items, EVENT_DEFAULTS
from fairground.operators.ranks import counts_before, quantiles, row_numbers
from fairground.operators.relations import exact_duplicates

SCHEMA = "uuid string, title string, description string, price double, category string, venue string, date string, url string"


def frame(spark, rows):
    full = [(str(i), f"title {i}", r.get("d", "x" * 60), r.get("p"), r.get("c", "a"), r.get("v", "v"), r.get("t", "2026-05-04 20:00:00"), "u")
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def prices(spark, values, category="a"):
    return normalize_events(frame(spark, [{"p": v, "c": category} for v in values]))


def test_normalize(spark):
    df = normalize_events(frame(spark, [{"p": None, "c": None, "v": "", "d": None, "t": "2025 Aralık 10"}, {"p": 5.0}]))
    a, b = df.orderBy("uuid").collect()
    assert (a.price, a.category, a.venue, a.has_description, a.date, a.month) == (0.0, "unknown", "unknown", False, None, None)
    assert (b.price, b.day_of_week, b.hour, b.month, b.description_length) == (5.0, 0, 20, 5, 60)


def test_validation(spark):
    rows = [("a", "100", "s"), ("", "5", "s"), (None, "5", "s"), ("b", "-1", None), ("c", "100001", ""), ("d", "x", "s"), ("e", "", "s"), ("f", "0", "s")]
    df = validate_items(spark.createDataFrame(rows, "title string, price string, source string"), "spider")
    good = {r.title: (r.price, r.source) for r in accepted(df).collect()}
    assert good == {"a": (100.0, "s"), "b": (None, "spider"), "c": (None, "spider"), "d": (None, "s"), "e": (None, "s"), "f": (0.0, "s")}
    assert [r.reject_reason for r in rejected(df).collect()] == ["Missing title"] * 2


def test_collapse(spark):
    df = spark.createDataFrame([(None, None, None)], "title string, price double, category string")
    assert tuple(collapse_nulls(df, EVENT_DEFAULTS).first()) == ("", None, "Etkinlik")


def _numpy_quantile(values, p):
    s = sorted(values)
    at = p * (len(s) - 1)
    lo = math.floor(at)
    hi = math.ceil(at)
    return s[lo] + (s[hi] - s[lo]) * (at - lo)


def test_quantiles_against_sorting(spark):
    rng = random.Random(5)
    groups = {
        "hot": [rng.choice([1.0, 2.0, 7.5]) for _ in range(3000)],
        "spread": [rng.lognormvariate(3, 2) for _ in range(2000)],
        "one": [4.0],
        "same": [3.0] * 50,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("nulls", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: r for r in quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(_numpy_quantile(vs, p), rel=1e-12)
    whole = quantiles(df, "v", probs).first()
    everything = [v for vs in groups.values() for v in vs]
    assert whole["c"] == pytest.approx(_numpy_quantile(everything, 0.5))
    assert quantiles(df.filter("g = 'nulls'"), "v", probs).count() == 0


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = row_numbers(df, "k", ["g"]).collect()
    for g in range(3):
        assert [r.row_number for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == list(range(1, sum(r.g == g for r in got) + 1))


def test_price_summary(spark):
    r = stats.price_summary(prices(spark, [1.0, 2.0, 3.0, 4.0, 0.0, None])).first()
    assert (r.n, r["mean"], r["median"], r["min"], r["max"]) == (4, 2.5, 2.5, 1.0, 4.0)
    assert r["std"] == pytest.approx(statistics.stdev([1, 2, 3, 4])) and r.cv == pytest.approx(51.6397779)


def test_empty_and_single(spark):
    nothing = prices(spark, [None, 0.0])
    assert stats.price_summary(nothing).first()["n"] == 0
    assert stats.category_stats(nothing).count() == 0
    assert stats.box_plot(nothing, by="category").count() == 0
    assert rollups.headline(nothing.limit(0)).first()["mean_price"] == 0.0
    one = stats.category_stats(prices(spark, [5.0])).first()
    assert (one.n, one["std"], one.q1, one.q3) == (1, None, 5.0, 5.0)
    assert [r.n for r in rollups.day_of_week(nothing.limit(0)).collect()] == [0] * 7
    assert [r.n for r in rollups.price_bands(nothing).collect()] == [0] * 4


def test_modes_and_shape(spark):
    df = prices(spark, [1.0, 1.0, 2.0, 2.0, 9.0])
    assert [r.price for r in stats.modes(df).collect()] == [1.0, 2.0]
    assert stats.price_shape(df).first().shape == "right-skewed (positively skewed)"


def test_weekly_and_eta(spark):
    df = frame(spark, [{"p": 10.0, "t": "2024-01-01 10:00:00"}, {"p": None, "t": "2024-01-02 10:00:00"}]).withColumn("date", F.col("date").cast("timestamp"))
    assert tuple(rollups.weekly(df).first()) == ("2024-W01", 2, 10.0)
    row = spark.range(1).select(
        rollups.eta_text(F.lit(100), F.lit(10.0)).alias("a"), rollups.eta_text(F.lit(125), F.lit(1.0)).alias("b"),
        rollups.eta_text(F.lit(5), F.lit(0.0)).alias("c"), rollups.gauge(F.lit(7.5)).alias("g"),
    ).first()
    assert tuple(row) == ("~10 min", "~2h 5m", None, 93)


def test_rate(spark):
    rows = [(i, i * 60, i * i) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, s long, total int").withColumn("ts", F.timestamp_seconds("s"))
    assert rollups.rate(df, "total").first().per_minute == pytest.approx((49 - 9) / 4)
    assert rollups.rate(df.limit(1), "total").first().per_minute is None


def test_anova_and_ttest(spark):
    rows = [{"p": float(v), "c": c} for c, vs in {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5, 6, 7]}.items() for v in vs]
    df = normalize_events(frame(spark, rows))
    r = hypothesis.anova(df).first()
    assert r.f_statistic == pytest.approx(13.0) and r.p_value == pytest.approx((16 / 3) ** -3) and r.significant
    t = hypothesis.ttest_extremes(df).first()
    assert (t.cheapest_category, t.most_expensive_category, t.price_difference) == ("a", "c", 4.0)
    assert t.t_statistic == pytest.approx(-4 / math.sqrt(2 / 3)) and t.p_value == pytest.approx(0.008050, abs=1e-5)
    assert hypothesis.anova(prices(spark, [1.0, 2.0])).first().f_statistic is None
    assert hypothesis.ttest_extremes(prices(spark, [1.0, 2.0])).count() == 0


def test_shapiro(spark):
    classic = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = [{"p": float(v), "c": "classic"} for v in classic] + [{"p": float(v), "c": "three"} for v in (1, 2, 4)]
    rows += [{"p": 1.0, "c": "two"}, {"p": 2.0, "c": "two"}]
    normal = statistics.NormalDist(500, 50)
    rows += [{"p": normal.inv_cdf((i + 0.5) / 200), "c": "normal"} for i in range(200)]
    got = {r.category: r for r in hypothesis.shapiro(normalize_events(frame(spark, rows))).collect()}
    assert got["classic"].statistic == pytest.approx(0.7888, abs=2e-4) and got["classic"].p_value == pytest.approx(0.0067, abs=2e-4)
    assert got["three"].statistic == pytest.approx(0.9643, abs=1e-4) and got["three"].p_value == pytest.approx(0.6369, abs=1e-3)
    assert got["two"].note == "Insufficient data" and got["normal"].is_normal and got["normal"].statistic > 0.99
    big = hypothesis.shapiro(normalize_events(frame(spark, rows)), max_n=50)
    assert {r.category for r in big.collect() if r.note and r.note.startswith("Skipped")} == {"normal"}


def _shapiro_w(values):
    """W from its definition, all values in one list."""
    x, n = sorted(values), len(values)
    m = [statistics.NormalDist().inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm, u = sum(v * v for v in m), n**-0.5
    poly = lambda cs: functools.reduce(lambda acc, c: acc * u + c, cs)
    a_n = poly((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)) + m[-1] / mm**0.5
    a_n1 = poly((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)) + m[-2] / mm**0.5
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a_n**2 - 2 * a_n1**2)
    a = [-a_n, -a_n1, *[v / phi**0.5 for v in m[2:-2]], a_n1, a_n]
    mean = statistics.fmean(x)
    return sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)


@pytest.mark.parametrize("piece", [7, 4096])
def test_shapiro_with_a_hot_price(spark, monkeypatch, piece):
    monkeypatch.setattr(hypothesis, "RANKS", piece)
    rng = random.Random(1)
    groups = {"hot": [250.0] * 400 + [rng.lognormvariate(6, 1) for _ in range(800)], "lowest": [1.0] * 50 + [2.0, 3.0, 9.0],
              "highest": [9.0] * 50 + [2.0, 3.0], "distinct": [rng.gauss(500, 50) for _ in range(300)]}
    rows = [{"p": v, "c": c} for c, values in groups.items() for v in values] + [{"p": 5.0, "c": "equal"}] * 40
    got = {r.category: r for r in hypothesis.shapiro(normalize_events(frame(spark, rows))).collect()}
    for c, values in groups.items():
        assert got[c].n == len(values) and got[c].statistic == pytest.approx(_shapiro_w(values), abs=1e-9), c
    assert got["equal"].statistic == 1.0 and got["equal"].n == 40  # no spread: nothing speaks against a normal


def test_counts_before_equal_row_numbers(spark):
    rng = random.Random(9)
    rows = [(g, float(v), rng.randint(1, 5)) for g in "ab" for v in rng.sample(range(10_000), 700)]
    got = {(r.g, r.v): r.before for r in counts_before(spark.createDataFrame(rows, "g string, v double, w int"), "v", "w", ["g"]).collect()}
    for g in "ab":
        total = 0
        for _, v, w in sorted(r for r in rows if r[0] == g):
            assert got[g, v] == total
            total += w


def test_ks(spark):
    values = [float(v * v) for v in range(1, 40)]
    r = hypothesis.ks_normal(prices(spark, values)).first()
    d = statistics.NormalDist(statistics.mean(values), statistics.stdev(values))
    n = len(values)
    want = max(max((i + 1) / n - d.cdf(v), d.cdf(v) - i / n) for i, v in enumerate(values))
    assert r.statistic == pytest.approx(want)
    assert hypothesis.ks_normal(prices(spark, [1.0, 1.0, 1.0])).count() == 0


def test_outliers_with_zero_mad(spark):
    df = prices(spark, [10.0] * 9 + [11.0])
    r = anomaly.outlier_summary(df).first()
    assert (r.total_outliers, r.iqr_method, r.modified_z_score_method) == (1, 1, 1)


def test_detectors(spark):
    as_of = F.lit("2026-05-10").cast("timestamp")
    df = normalize_events(frame(spark, [
        {"p": 2000.0}, {"p": 19.99}, {"p": None, "c": "seminar"}, {"p": 0.0}, {"p": 5.0, "t": "2027-06-01 04:00:00"},
        {"p": 5.0, "t": None, "d": ""},
    ]))
    rows = anomaly.anomaly_rows(df, as_of)
    counts = {(r.type, r.severity): r.n for r in anomaly.anomaly_counts(rows).collect()}
    assert counts[("suspiciously_round_price", "low")] == 1 and counts[("free_event_in_paid_category", "low")] == 1
    assert counts[("past_event", "medium")] == 4 and counts[("far_future_event", "low")] == 1 and counts[("unusual_time", "low")] == 1
    assert counts[("missing_description", "medium")] == 1
    scores = {r.uuid: r.score for r in anomaly.anomaly_score(df, rows).collect()}
    assert scores["2"] == 20 and scores["4"] == 20 and scores["5"] == 20 and scores["3"] == 30
    assert anomaly.psychological_pricing(df).first().n == 4
    assert anomaly.completeness(df).first().completeness == pytest.approx(100 - 2 / 24 * 100)
    assert anomaly.temporal_summary(df, as_of).first().n_past == 4
    listed = anomaly.reported_rows(rows, 2)
    assert listed.filter("type = 'past_event'").count() == 2


def test_integrity(spark):
    df = frame(spark, [{"p": 250.0}, {"p": None}, {"p": 0.0}]).withColumn("title", F.lit("ab"))
    got = {r.check: (r.n, r.failed) for r in anomaly.integrity_checks(df, exact_duplicates(df)).collect()}
    assert got["short_title"] == (3, True) and got["default_price"] == (1, False) and got["duplicate_sets"] == (1, True)
    assert got["missing_price"] == (1, False) and got["priced"] == (2, False)
