"""Streams of many small triggers: what a trigger leaves, and waiting for many of them."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import Row, functions as F

from fairground.streaming import counters, progress


def event(batch, **values):
    values = {"seen": 5, **values}
    return SimpleNamespace(progress=SimpleNamespace(observedMetrics={"items": Row(**values)}, numInputRows=5, batchId=batch, runId="r"))


def test_a_triggers_counters_take_no_job(spark, tmp_path):
    listener = counters.TriggerCounters(spark, f"file://{tmp_path}/counters", "items")
    spark.sparkContext.setJobGroup("counters", "")
    try:
        for batch, best in ((0, 1.5), (1, None), (1, None), (2, 2.5)):
            listener.onQueryProgress(event(batch, best=best, name="x", open=True))
        assert listener.failure is None
        assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("counters"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stored = counters.read_counters(spark, f"{tmp_path}/counters")
    assert {"seen": "bigint", "best": "double", "name": "string", "open": "boolean"}.items() <= dict(stored.dtypes).items()
    assert sorted((r.batch, r.seen, r.best, r.name, r.open) for r in stored.collect()) == [(0, 5, 1.5, "x", True), (1, 5, None, "x", True), (2, 5, 2.5, "x", True)]
    assert len([f for f in os.listdir(tmp_path / "counters/batch=1") if not f.startswith(".")]) == 1


def test_other_values_are_stored_too(spark, tmp_path):
    listener = counters.TriggerCounters(spark, str(tmp_path / "counters"), "items")
    at = spark.sql("SELECT TIMESTAMP '2026-01-02 03:04:05' AS t").first().t
    listener.onQueryProgress(event(3, last=at))
    assert listener.failure is None
    (row,) = counters.read_counters(spark, str(tmp_path / "counters")).collect()
    assert (row.seen, row["last"], row.batch) == (5, at, 3)


def test_waiting_goes_on_while_triggers_are_reported(spark, tmp_path, monkeypatch):
    """Many triggers may be reported later than the patience, as long as each one is reported within it."""
    listener = counters.TriggerCounters(spark, str(tmp_path), "items")
    query = SimpleNamespace(lastProgress=SimpleNamespace(batchId=5), runId="r")
    clock = SimpleNamespace(now=0.0)

    def sleep(_):
        clock.now += 0.4
        listener.stored["r"] = min(int(clock.now // 0.8), 5)

    monkeypatch.setattr(counters, "time", SimpleNamespace(monotonic=lambda: clock.now, sleep=sleep))
    listener.wait(query, seconds=1)
    assert clock.now > 3
    query.lastProgress.batchId = 6
    with pytest.raises(TimeoutError, match="trigger 6"):
        listener.wait(query, seconds=1)


def test_steps_start_with_plain_renames_on_a_local_disk(spark, tmp_path):
    seen, found = [], spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = SimpleNamespace(option=lambda *a: SimpleNamespace(start=lambda: seen.append((a, spark.conf.get(counters._MANAGER, None)))))
    counters.start_steps(spark, writer, str(tmp_path / "cp"))
    assert seen == [(("checkpointLocation", str(tmp_path / "cp")), counters._PLAIN)] and spark.conf.get(counters._MANAGER, None) is None
    spark.conf.set(counters._MANAGER, "own")
    try:
        counters.start_steps(spark, writer, str(tmp_path / "cp"))
        assert seen[1][1] == spark.conf.get(counters._MANAGER) == "own"
    finally:
        spark.conf.unset(counters._MANAGER)
    assert found.isStreaming


def test_a_price_stream_makes_its_expressions_once(spark, tmp_path, monkeypatch):
    made = []
    priced = progress._priced
    monkeypatch.setattr(progress, "_priced", lambda stamp: made.append(1) or priced(stamp))
    schema = "uuid string, price string, category_prices string, scraped_at timestamp"
    (tmp_path / "in").mkdir()
    for i in range(2):
        spark.sql(f"SELECT 'a{i}' AS uuid, '7{i}' AS price, CAST(NULL AS STRING) AS category_prices, TIMESTAMP '2026-01-01' AS scraped_at").write.parquet(str(tmp_path / f"in/{i}"))
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    stream = progress.reprice_stream(found, str(tmp_path), str(tmp_path / "cp"), F.lit("2026-02-01").cast("timestamp"), "0 seconds")
    counters.run_steps(stream)
    rows = spark.read.parquet(str(tmp_path / "events.patches")).collect()
    assert sorted((r.uuid, r.price) for r in rows) == [("a0", 70.0), ("a1", 71.0)] and {r.batch for r in rows} == {0, 1} and made == [1]
