"""Batches of the ingest: what they leave on disk, turns, and what goes beside the events."""

import re
import time

import pytest
from pyspark.sql import functions as F

from fairground.plans import streams
from fairground.schemas import CONTENT, EVENTS, PERSON_EVENT
from fairground.sources import versions
from fairground.streaming import ingest

AS_OF = "TIMESTAMP '2026-01-01'"
COLUMNS = ("uuid string, title string, venue string, date string, price double, rating double, rating_count int, "
           "reviews array<struct<content_type: string, text: string, rating: double, author: string>>, "
           "extracted_entities array<struct<name: string, role: string>>, is_update_job boolean, scraped_at timestamp, reject_reason string")  # fmt: skip


def item(spark, uuid, title, day=1, price=1.0, update=False, said=None, people=None, rating=None, venue=None, reason=None):
    at = spark.sql(f"SELECT TIMESTAMP '2025-01-{day:02d}' AS t").first().t
    reviews = None if said is None else [("user_review", said, None, None)]
    return (uuid, title, venue, "2025-05", price, rating, None if rating is None else 1, reviews, people, update, at, reason)


def batch(spark, *rows):
    df = spark.createDataFrame(list(rows), COLUMNS)
    return ingest.fill(df, f"{ingest.ITEM.strip()}, reject_reason string").withColumn("price", F.col("price").cast("double"))


def stored(spark, out):
    rows = versions.read_log(spark, f"{out}/events", EVENTS)
    return sorted(tuple(r) for r in rows.select("uuid", "title", "venue", "price", "batch").collect())


def shuffles(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return set(re.findall(r"/shuffle_(\d+)_", env.blockManager().diskBlockManager().getAllFiles().mkString(",")))


@pytest.fixture()
def two(spark):
    """A first batch, and one with known keys, repeated and blank ones, an update of either batch's event and of none."""
    first = [item(spark, f"a{i}", f"T{i}", price=float(i)) for i in range(9)]
    second = [
        *[item(spark, f"b{i}", f"T{i} ", day=2) for i in range(6, 12)], item(spark, "b20", "New", day=5), item(spark, "b21", " New", day=4, price=7.0),
        item(spark, None, "New", venue="Hall"), item(spark, "a1", "T1", price=50.0, update=True, day=9), item(spark, "b21", "x", price=60.0, update=True, day=8),
        item(spark, "nobody", "x", price=2.0, update=True), item(spark, "bad", None, reason="Missing title"),
    ]
    return batch(spark, *first), batch(spark, *second)


@pytest.mark.parametrize("rows", [50_000_000, 4])
def test_turns_write_the_same_rows(spark, tmp_path, monkeypatch, two, rows):
    monkeypatch.setattr(versions, "TURN_ROWS", rows)
    out = str(tmp_path)
    for number, df in ((0, two[0]), (1, two[1]), (1, two[1])):
        ingest.store_batch(df, number, out, F.expr(AS_OF))
    digest = two[1].select(F.sha2(F.lit("New|Hall|2025-05"), 256)).first()[0]
    want = [(f"a{i}", f"T{i}", "", float(i), 0) for i in range(9)] + [(f"b{i}", f"T{i}", "", 1.0, 1) for i in range(9, 12)]
    want += [("b21", "New", "", 60.0, 1), (digest, "New", "Hall", 1.0, 1), ("a1", "T1", "", 50.0, 1)]
    assert stored(spark, out) == sorted(want)
    versions.compact(spark, f"{out}/events", f"{out}/folded", EVENTS, "uuid")
    folded = versions.read_log(spark, f"{out}/folded", EVENTS)
    assert {(r.uuid, r.price) for r in folded.collect()} == {(u, p) for u, _, _, p, n in want if (u, n) != ("a1", 0)} and folded.count() == 14
    if rows == 4:
        assert len(versions.turns(9)) == 3 and not [f for f in (tmp_path / "events").iterdir() if f.name.startswith("_batch")]


def test_a_batch_leaves_no_shuffle_files_and_no_copy(spark, tmp_path, two):
    bare = [df.drop("rating", "reviews", "extracted_entities") for df in two]
    before, held = shuffles(spark), set(spark.sparkContext._jsc.getPersistentRDDs())
    for number, df in enumerate(bare):
        ingest.store_batch(ingest.fill(df, f"{ingest.ITEM.strip()}, reject_reason string"), number, str(tmp_path), F.expr(AS_OF))
    versions.compact(spark, f"{tmp_path}/events", f"{tmp_path}/folded", EVENTS, "uuid")
    until = time.monotonic() + 20  # files go in the background
    while shuffles(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held


def test_new_items_are_moved_once(spark, two):
    stored = spark.createDataFrame([("T1", None, "2025-05")], "title string, venue string, date_raw string")
    fresh = ingest.new_in_batch(two[0], stored)
    assert sorted(r.title for r in fresh.collect()) == [f"T{i}" for i in range(9) if i != 1]
    assert fresh._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_items_alike_in_time_and_uuid_are_told_apart_the_same_way(spark):
    rows = [item(spark, "u", "T", price=float(p), said=f"s{p}") for p in range(40)]
    none = spark.createDataFrame([], "title string, venue string, date_raw string")
    for seed in range(3):
        (first,) = ingest.new_in_batch(batch(spark, *rows).orderBy(F.rand(seed)).repartition(seed + 1), none).collect()
        assert first.price == 0.0 and first.reviews[0].text == "s0"


def test_content_and_people_are_those_of_the_first_item(spark, tmp_path):
    """The later item of a key has a review and people, the first has none; of another key the first has them."""
    out = str(tmp_path)
    rows = [item(spark, "u1", "A"), item(spark, "u2", "A", day=2, said="late", people=[("P", "WROTE")], rating=3.0),
            item(spark, "u3", "B", said="early", people=[("Q", "WROTE"), ("R", "ADAPTED")], rating=4.0), item(spark, "u4", "B", day=2, said="late"), item(spark, "u5", "C")]
    for _ in range(2):
        ingest.store_batch(batch(spark, *rows), 0, out, F.expr(AS_OF))
    assert [r[0] for r in stored(spark, out)] == ["u1", "u3", "u5"]
    content = versions.read_log(spark, f"{out}/content", CONTENT).collect()
    assert sorted((r.event_uuid, r.content_type, r.text) for r in content) == [("u3", "platform_rating", None), ("u3", "user_review", "early")]
    assert [r.event_uuid for r in versions.read_log(spark, f"{out}/person_event", PERSON_EVENT).collect()] == ["u3"]
    assert [r.reject_reason for r in versions.read_log(spark, f"{out}/rejected", ingest.REJECTED).collect()] == ["Invalid relationship type: ADAPTED"]
    ingest.store_batch(batch(spark, *rows), 1, out, F.expr(AS_OF))  # all of it is known now
    assert versions.read_log(spark, f"{out}/content", CONTENT).count() == 2


def test_items_show_nulls_as_before(spark):
    line = ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp, l_returnflag string, "
            "l_linestatus string, l_extendedprice double")  # fmt: skip
    rows = [(1, 2, None, 4, None, "N", "O", 1.0), (None, None, 3, None, None, "N", "O", 1.0)]
    got = streams.items(spark.createDataFrame(rows, line)).select("uuid", "title", "venue").collect()
    assert [tuple(r) for r in got] == [("1-2-null-4-null", "Part null", " supplier 4 "), ("null-null-3-null-null", "Part 3", " supplier null ")]


def test_current_takes_columns_keys_and_shares(spark, tmp_path):
    """Patches of other keys, of columns not wanted and of another turn stay out; what is moved has the wanted columns only."""
    log = str(tmp_path / "events")
    rows = "SELECT concat('u', id) AS uuid, concat('T', id) AS title, 1.0D AS price, TIMESTAMP '2026-01-01' AS updated_at FROM range(20)"
    versions.write_batch(ingest.fill(spark.sql(rows), EVENTS), log, 0)
    new = "SELECT concat('u', id) AS uuid, 2.0D AS price, CAST(NULL AS ARRAY<STRUCT<name: STRING, price: DOUBLE>>) AS category_prices, TIMESTAMP '2026-02-01' AS updated_at FROM range(0, 30, 2)"
    versions.write_patches(spark.sql(new), log, 0)
    want = {(f"u{i}", 2.0 if i % 2 == 0 else 1.0) for i in range(20)}
    narrow = versions.current(spark, log, EVENTS, "uuid", columns=["uuid", "price"])
    assert narrow.columns == ["uuid", "price"] and {tuple(r) for r in narrow.collect()} == want
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(uuid, uuid" in plan and "title, title" not in plan and "category_prices, category_prices" not in plan
    shares = [{tuple(r) for r in versions.current(spark, log, EVENTS, "uuid", columns=["uuid", "price"], turn=(i, 3)).collect()} for i in range(3)]
    assert set().union(*shares) == want and sum(map(len, shares)) == 20 and all(shares)
    due = spark.sql("SELECT * FROM VALUES ('u2'), ('u3'), ('none') t(uuid)")
    assert {tuple(r) for r in versions.current(spark, log, EVENTS, "uuid", only=due).select("uuid", "price").collect()} == {("u2", 2.0), ("u3", 1.0)}
