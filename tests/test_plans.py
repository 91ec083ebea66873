"""Shapes the physical plans must keep."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fairground.plans import fields, streams
from fairground.sources import pages

SF = "/root/testdata/sf0.001"


def plan(spark, key):
    return entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["p07_kept_filter", "d04_outlier_summary", "a19_day_of_week", "v03_hybrid_search", "j10_link_similar",
                                 "t08_fallback_candidates", "a15_full_report"])
def test_no_nested_loop_joins(spark, key):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan(spark, key))


def test_filters_and_columns_reach_the_files(spark):
    assert "EqualTo(o_orderkey,4242)" in plan(spark, "p03_by_uuid")
    assert "ReadSchema: struct<l_extendedprice:double>" in plan(spark, "a01_price_summary")


@pytest.mark.parametrize("key", ["t07_latest_per_source", "w03_last_snapshots", "v01_vector_top_k"])
def test_ranks_are_limited_before_the_shuffle(spark, key):
    assert "WindowGroupLimit" in plan(spark, key)


def test_exact_quantiles_share_one_shuffle_of_the_values(spark):
    from fairground.operators.ranks import quantiles

    df = spark.read.parquet(f"{SF}/events.parquet")
    out = quantiles(df, "value", {"m": 0.5}, ["event_type"])
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in final and "ReusedExchange" in final


def test_halves_share_one_cut(spark):
    """The rows come in another order, and so with another approximate median, each time they are read."""
    import random

    import pandas as pd

    def shuffled(batches):
        for batch in batches:
            yield batch.sample(frac=1, random_state=random.SystemRandom().randrange(2**31)).reset_index(drop=True)

    whole, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(whole, "0")
    try:
        rows = spark.range(0, 400_000, 1, 2).selectExpr("id * 7919 % 400009 AS k").mapInPandas(shuffled, "k long")
        for _ in range(3):
            first, second = streams._halves(rows.select(F.timestamp_micros("k").alias("scraped_at")))
            assert first.count() + second.count() == 400_000
    finally:
        spark.conf.set(whole, before)


def test_event_pages_keep_their_parts(spark):
    """Small rows, long work: they are not merged into one task."""
    made = fields.event_pages(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
    assert made == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pages_are_walked_few_at_a_time(spark):
    made = spark.range(0, 1000, 1, 1).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id, '</p>') AS html")
    found = pages.extract_fields(made, {"p": ("p", "text")})
    assert [(r.page_id, r.p[0].value) for r in found.orderBy("page_id").collect()] == [(i, str(i)) for i in range(1000)]


def test_listing_pages_keep_their_parts(spark):
    made = fields._site_b_pages(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
    assert made == int(spark.conf.get("spark.sql.shuffle.partitions"))
