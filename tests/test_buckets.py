"""Bucketed tables, duplicates by keyed state, and the ingest made of both."""

from __future__ import annotations

import json
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fairground.schemas import CONTENT
from fairground.sources import buckets, versions
from fairground.streaming import ingest, keyed_ingest, keystate

SCHEMA = "uuid string, price double, updated_at int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for n in names if n.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    made = spark.range(200).select(F.col("id").cast("string").alias("uuid"), F.lit(1.0).alias("price"), F.lit(0).alias("updated_at"))
    buckets.create(spark, path, SCHEMA, buckets=16, rows=made)
    return path


def test_a_change_leaves_other_buckets_alone(spark, table):
    before, old = files(table), buckets.version(spark, table)
    updates = spark.createDataFrame([("7", 2.0, 1), ("7", 3.0, 2), ("new", 4.0, 1)], SCHEMA)
    assert buckets.upsert(spark, table, updates)
    after, now = files(table), buckets.version(spark, table)
    assert {f: t for f, t in after.items() if f in before} == before
    changed = {b for b in now.folders if now.folders[b] != old.folders.get(b)}
    assert 1 <= len(changed) <= 2 and len(after) - len(before) == len(changed)
    want = {(str(i), 1.0, 0) for i in range(200) if i != 7} | {("7", 3.0, 2), ("new", 4.0, 1)}
    assert set(rows(buckets.read(spark, table))) == want
    # the version before is still whole
    assert set(rows(buckets.read(spark, table, number=0))) == {(str(i), 1.0, 0) for i in range(200)}


def test_patch_overlay_delete(spark, table):
    buckets.patch(spark, table, spark.createDataFrame([("1", None, 5), ("nobody", 9.0, 5)], SCHEMA), ["price", "updated_at"])
    buckets.overlay(spark, table, spark.createDataFrame([("2", None, 7), ("x", 8.0, 7)], SCHEMA))
    buckets.delete(spark, table, spark.createDataFrame([(str(i),) for i in range(10, 200)], "uuid string"))
    got = set(rows(buckets.read(spark, table)))
    assert got == {(str(i), 1.0, 0) for i in (0, *range(3, 10))} | {("1", None, 5), ("2", 1.0, 7), ("x", 8.0, 7)}
    buckets.delete(spark, table, buckets.read(spark, table).select("uuid"))
    assert rows(buckets.read(spark, table)) == [] and buckets.version(spark, table).folders == {}
    buckets.upsert(spark, table, spark.createDataFrame([("again", 1.0, 1)], SCHEMA))
    assert rows(buckets.read(spark, table)) == [("again", 1.0, 1)]


def test_lookup_reads_only_its_buckets(spark, table):
    keys = spark.createDataFrame([("3",), ("nobody",)], "uuid string")
    own = buckets._touched(buckets.version(spark, table), keys)
    for f in files(table):
        if int(f.split("bucket=")[1].split("/")[0]) not in own:
            with open(f, "w") as broken:
                broken.write("no parquet")
    assert rows(buckets.lookup(spark, table, keys)) == [("3", 1.0, 0)]


def test_children_need_their_parent(spark, table, tmp_path):
    child = str(tmp_path / "child")
    schema = "uuid string, event_uuid string, updated_at int"
    buckets.create(spark, child, schema, buckets=4)
    buckets.upsert_children(spark, child, spark.createDataFrame([("c1", "5", 1), ("c2", "nobody", 1), ("c3", None, 1)], schema), table)
    assert rows(buckets.read(spark, child)) == [("c1", "5", 1)]


def test_replays_conflicts_and_half_writes(spark, table, monkeypatch):
    def update(price):
        return spark.createDataFrame([("7", price, 1)], SCHEMA)

    assert buckets.upsert(spark, table, update(2.0), writer="w", batch_id=3)
    assert not buckets.upsert(spark, table, update(5.0), writer="w", batch_id=3)
    assert buckets.upsert(spark, table, update(6.0), writer="v", batch_id=0)
    commit = buckets._commit
    monkeypatch.setattr(buckets, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        buckets.upsert(spark, table, update(7.0), writer="w", batch_id=4)
    monkeypatch.setattr(buckets, "_commit", commit)
    assert ("7", 6.0, 1) in rows(buckets.read(spark, table))

    def late(old):
        buckets.upsert(spark, table, update(8.0))  # another writer in between
        return old

    with pytest.raises(buckets.Conflict):
        buckets.change(spark, table, update(0.0), late)
    assert ("7", 8.0, 1) in rows(buckets.read(spark, table))
    buckets.expire(spark, table)
    kept = buckets.version(spark, table)
    assert {f.split("/data/")[1].split("/")[0] for f in files(table)} == set(kept.folders.values())
    assert len(rows(buckets.read(spark, table))) == 200
    with pytest.raises(ValueError):
        buckets.create(spark, table, SCHEMA)


@pytest.fixture
def keyed(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, keystate.PROVIDER)
    yield spark
    spark.conf.set(PROVIDER, before)


ITEM = {"uuid": "u1", "title": "Gala", "venue": "Hall", "date": "2026 Mart 05", "price": "100", "source": "s", "scraped_at": "2026-01-01T10:00:00Z"}


def land(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({**ITEM, **i}) for i in items))


def marks(spark, tmp_path, ttl, stored=None):
    stream = keystate.mark_duplicates(ingest.read_items(spark, str(tmp_path / "in")), ttl, stored=stored)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "marked"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return {r.uuid: r.duplicate for r in spark.read.parquet(str(tmp_path / "marked")).collect()}


def test_a_key_returns_after_its_time(keyed, tmp_path):
    spark = keyed
    stored = spark.sql("SELECT 'Old' AS title, 'Hall' AS venue, CAST(NULL AS STRING) AS date, TIMESTAMP '2026-01-01 00:00:00Z' AS scraped_at")
    land(tmp_path / "in", "1.json", {}, {"uuid": "u2", "title": " Gala ", "scraped_at": "2026-01-01T10:00:01Z", "reviews": [{"text": "x", "rating": 4.5}]},
         {"uuid": "u3", "venue": None}, {"uuid": "u4", "title": "Old", "date": ""}, {"uuid": "u5", "title": "Old"})
    assert marks(spark, tmp_path, timedelta(days=2), stored) == {"u1": False, "u2": True, "u3": False, "u4": True, "u5": False}
    land(tmp_path / "in", "2.json", {"uuid": "v1", "scraped_at": "2026-01-03T09:59:59Z"})
    assert marks(spark, tmp_path, timedelta(days=2), stored)["v1"]
    # after the time to live: new again, and the others' timers fire
    land(tmp_path / "in", "3.json", {"uuid": "w1", "scraped_at": "2026-01-03T10:00:00Z"}, {"uuid": "w2", "scraped_at": "2026-01-03T10:00:01Z"})
    got = marks(spark, tmp_path, timedelta(days=2), stored)
    assert (got["w1"], got["w2"]) == (False, True)
    land(tmp_path / "in", "4.json", {"uuid": "x1", "title": "Late", "scraped_at": "2026-02-01T00:00:00Z"})
    marks(spark, tmp_path, timedelta(days=2), stored)
    state = spark.read.format("statestore").option("stateVarName", "accepted").load(str(tmp_path / "cp"))
    assert [r.key.title for r in state.select("key").collect()] == ["Late"]
    whole = spark.read.parquet(str(tmp_path / "marked")).where("uuid = 'u2'").first()
    assert (whole.reviews[0].text, whole.reviews[0].rating, whole.price, whole.title) == ("x", 4.5, "100", "Gala")


def test_no_time_to_live_keeps_every_key(keyed, tmp_path):
    land(tmp_path / "in", "1.json", {})
    marks(keyed, tmp_path, None)
    land(tmp_path / "in", "2.json", {"uuid": "u2", "scraped_at": "2036-01-01T10:00:00Z"})
    assert marks(keyed, tmp_path, None) == {"u1": False, "u2": True}


def run(spark, tmp_path):
    items = ingest.read_items(spark, str(tmp_path / "in"))
    as_of = F.lit("2026-01-01").cast("timestamp")
    query = keyed_ingest.keyed_ingest_stream(items, str(tmp_path / "out"), str(tmp_path / "cp"), "spider", as_of=as_of, n_buckets=8)
    query.awaitTermination()


def events(spark, tmp_path):
    return {r.uuid: r for r in buckets.read(spark, str(tmp_path / "out/events")).collect()}


def test_keyed_ingest(keyed, tmp_path):
    spark = keyed
    land(tmp_path / "in", "1.json", {"reviews": [{"content_type": "user_review", "text": "good", "author": "A"}], "rating": 4.5, "rating_count": 7,
                                     "extracted_entities": [{"name": "P", "role": "WROTE"}, {"name": "Q", "role": "ADAPTED"}]},
         {"uuid": "u2", "title": " Gala ", "scraped_at": "2026-01-01T11:00:00Z"}, {"uuid": "u3", "title": ""}, {"uuid": "u4", "venue": None},
         *[{"uuid": f"m{i}", "title": f"Many {i}"} for i in range(30)])
    run(spark, tmp_path)
    stored = events(spark, tmp_path)
    assert set(stored) == {"u1", "u4", *(f"m{i}" for i in range(30))} and stored["u1"].price == 100.0
    # the next batch needs no file of another bucket
    new = spark.createDataFrame([("u1",), ("u6",)], "uuid string")
    own = buckets._touched(buckets.version(spark, str(tmp_path / "out/events")), new)
    for f in files(str(tmp_path / "out/events")):
        if int(f.split("bucket=")[1].split("/")[0]) not in own:
            os.rename(f, f + ".away")
    land(tmp_path / "in", "2.json", {"uuid": "u5", "scraped_at": "2026-01-02T00:00:00Z"}, {"uuid": "u6", "title": "Other", "scraped_at": "2026-01-02T00:00:00Z"},
         {"is_update_job": True, "price": "55", "scraped_at": "2026-01-02T00:00:00Z"}, {"uuid": "nobody", "title": "x", "is_update_job": True, "price": "1"})
    run(spark, tmp_path)
    for d, _, names in os.walk(tmp_path / "out/events"):
        for n in names:
            if n.endswith(".away"):
                os.rename(f"{d}/{n}", f"{d}/{n.removesuffix('.away')}")
    now = events(spark, tmp_path)
    assert set(now) == set(stored) | {"u6"} and now["u1"].price == 55.0 and now["u1"].title == "Gala"
    content = versions.read_log(spark, str(tmp_path / "out/content"), CONTENT)
    assert {(r.event_uuid, r.content_type) for r in content.collect()} == {("u1", "user_review"), ("u1", "platform_rating")}
    dropped = versions.read_log(spark, str(tmp_path / "out/rejected"), ingest.REJECTED)
    assert {(r.uuid, r.reject_reason) for r in dropped.collect()} == {
        ("u3", "Missing title"), ("u2", "Duplicate event"), ("u5", "Duplicate event"), ("u1", "Invalid relationship type: ADAPTED")
    }
    # a new checkpoint starts from the stored keys
    land(tmp_path / "in2", "1.json", {"uuid": "u9"}, {"uuid": "u10", "title": "Fresh"})
    items = ingest.read_items(spark, str(tmp_path / "in2"))
    keyed_ingest.keyed_ingest_stream(items, str(tmp_path / "out"), str(tmp_path / "cp2"), "spider", as_of=F.lit("2026-01-01").cast("timestamp")).awaitTermination()
    assert set(events(spark, tmp_path)) == set(now) | {"u10"}


@pytest.mark.parametrize("where", ["before", "after"])
def test_a_killed_batch_runs_again(keyed, tmp_path, monkeypatch, where):
    """The batch dies just before, or just after, its events are committed."""
    land(tmp_path / "in", "1.json", {"rating": 4.5, "rating_count": 7}, {"uuid": "u2", "title": "B"}, {"uuid": "u3"})
    change = buckets.change

    def dying(*args, **options):
        if where == "after":
            change(*args, **options)
        raise OSError("executor lost")

    monkeypatch.setattr(buckets, "change", dying)
    with pytest.raises(Exception, match="executor lost"):
        run(keyed, tmp_path)
    monkeypatch.setattr(buckets, "change", change)
    run(keyed, tmp_path)
    assert set(events(keyed, tmp_path)) == {"u1", "u2"}
    content = versions.read_log(keyed, str(tmp_path / "out/content"), CONTENT)
    assert [(r.event_uuid, r.content_type) for r in content.collect()] == [("u1", "platform_rating")]


def test_keys_without_end_need_no_python(keyed, tmp_path, monkeypatch):
    """No Python call a key; the first by time is kept, in the batch and over batches, and a replayed batch agrees."""
    monkeypatch.setattr(keystate, "mark_duplicates", None)
    land(tmp_path / "in", "1.json", {"uuid": "b", "scraped_at": "2026-01-01T11:00:00Z"}, {"uuid": "a"}, {"uuid": "a"}, {"uuid": "c", "venue": " "},
         {"uuid": "d", "venue": None, "scraped_at": "2026-01-01T10:00:01Z"})
    run(keyed, tmp_path)
    land(tmp_path / "in", "2.json", {"uuid": "e", "scraped_at": "2020-01-01T00:00:00Z"}, {"uuid": "f", "title": "Past", "scraped_at": "2020-01-01T00:00:00Z"})
    run(keyed, tmp_path)
    assert set(events(keyed, tmp_path)) == {"a", "c", "f"}
    dropped = versions.read_log(keyed, str(tmp_path / "out/rejected"), ingest.REJECTED)
    assert sorted(r.uuid for r in dropped.collect()) == ["a", "b", "d", "e"]
