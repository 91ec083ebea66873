"""Daily states merged over batches against the statistics from scratch."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from fairground.operators import daily, rollups

KIND = "category string, venue string, price double, date timestamp"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, "", *[f"v{i}" for i in range(40)]]), rng.choice([None, 0.0, rng.lognormvariate(6, 1)]), d) for d in range(60) for _ in range(40)]
    rows += [(None, "v1", 10.0, None), ("a", "v1", 10.0, None), ("only free", "v2", 0.0, 3)]
    df = spark.createDataFrame(rows, "category string, venue string, price double, d int")
    return df.withColumn("date", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("d") * 86400)).drop("d").withColumn("i", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def paths(spark, events, tmp_path_factory):
    base = tmp_path_factory.mktemp("daily")
    for i in (0, 1, 2, 1):  # a replay at the end
        daily.add_batch(events.where(F.col("i") % 3 == i), str(base / "three"), i)
    daily.add_batch(events, str(base / "one"), 0)
    daily.fold(spark, str(base / "three"), str(base / "folded"))
    return base


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("name", ["three", "one", "folded"])
def test_dashboards_equal_those_from_scratch(spark, events, paths, name):
    state = daily.read_state(spark, str(paths / name))
    assert rows(daily.monthly(state)) == rows(rollups.monthly(events))
    assert rows(daily.weekly(state, 5)) == rows(rollups.weekly(events, 5))
    assert rows(daily.day_of_week(state)) == rows(rollups.day_of_week(events))
    assert rows(daily.price_bands(state)) == rows(rollups.price_bands(events))
    head, whole = daily.headline(state).first(), rollups.headline(events).first()
    assert (head.total_events, head.total_venues) == (whole.total_events, whole.total_venues)
    assert head.mean_price == pytest.approx(whole.mean_price)


def test_three_batches_and_one_agree(spark, events, paths):
    by_category = {}
    for r in events.where("price > 0").collect():
        by_category.setdefault(r.category, []).append(r.price)
    for name in ("three", "one", "folded"):
        got = {r.category: r for r in daily.category_summary(daily.read_state(spark, str(paths / name))).collect()}
        assert set(got) == set(by_category)
        for c, prices in by_category.items():
            r = got[c]
            assert (r.n, r.min, r.max) == (len(prices), min(prices), max(prices)) and r.mean == pytest.approx(statistics.mean(prices))
            assert r.std is None if len(prices) == 1 else r.std == pytest.approx(statistics.stdev(prices))
            for q, p in ((r.q1, 0.25), (r.median, 0.5), (r.q3, 0.75)):
                assert sum(x < q for x in prices) / len(prices) <= p + daily.RANK_ERROR
                assert sum(x <= q for x in prices) / len(prices) >= p - daily.RANK_ERROR
    assert daily.read_state(spark, str(paths / "folded")).count() < daily.read_state(spark, str(paths / "three")).count()


def test_quantile_error_beyond_exact_sizes(spark):
    df = spark.range(200_000).selectExpr(
        "'c' AS category", "concat('v', id % 30000) AS venue", "double(pmod(id * 7919, 200003)) + 1 AS price",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 9)) AS date",
    )
    state = daily.day_state(df)
    r = daily.category_summary(state).first()
    n = df.count()
    for q, p in ((r.q1, 0.25), (r.median, 0.5), (r.q3, 0.75)):
        assert abs(df.where(F.col("price") <= q).count() / n - p) <= daily.RANK_ERROR
    assert abs(daily.headline(state).first().total_venues - 30000) <= 3 * daily.DISTINCT_ERROR * 30000


def test_sets_of_venues(spark, events, paths):
    cut = "2023-12-10"
    got = {r.category: (r.either, r.both, r.only_first) for r in daily.venue_sets(daily.read_state(spark, str(paths / "three")), F.col("day") < cut, F.col("day") >= cut).collect()}
    sides = {}
    for r in events.where("venue <> ''").collect():
        if r.date is not None:
            sides.setdefault(r.category, (set(), set()))[str(r.date.date()) >= cut].add(r.venue)
    for c, (a, z) in sides.items():
        assert got[c] == (len(a | z), len(a & z), len(a - z))


def test_nothing(spark, events):
    state = daily.day_state(events.limit(0))
    assert daily.category_summary(state).count() == 0 and daily.monthly(state).count() == 0
    assert [r.n for r in daily.day_of_week(state).collect()] == [0] * 7 and [r.n for r in daily.price_bands(state).collect()] == [0] * 4
    assert tuple(daily.headline(state).first()) == (0, 0.0, 0.0, 0)


def test_exact_sets_of_many_venues(spark, tmp_path):
    """More venues than a sketch holds exactly; 5,000 of a day come back every other day."""
    df = spark.range(40_000).selectExpr(
        "'c' AS category", "concat('v', id % 10000) AS venue", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id DIV 5000)) AS date",
    )
    odd = spark.createDataFrame([("c", " ", None), ("none", None, None)], df.schema)
    for batch in (0, 1, 1):
        daily.add_venues(df.where(F.col("date") < "2024-01-04") if batch == 0 else df.unionByName(odd), str(tmp_path / "log"), batch)
    days = daily.read_venues(spark, str(tmp_path / "log"))
    got = daily.exact_venue_sets(days, F.col("day") < "2024-01-04", F.col("day") >= "2024-01-08").collect()
    assert {r.category: (r.either, r.both, r.only_first) for r in got} == {"c": (10000, 5000, 5000), "none": (0, 0, 0)}
