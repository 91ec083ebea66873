"""The bounded source of landed files: rows, steps, restarts, and landings that must not be passed over."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import Row, functions as F

from fairground.sources import paged
from fairground.streaming import counters


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def rows(spark, low, high):
    """Pages with nulls, empty texts and a long one; every id twice."""
    ids = spark.range(low, high).union(spark.range(low, high))
    html = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "").when(F.col("id") % 5 == 2, F.repeat(F.lit("ü"), 50_000)).otherwise("<p>x</p>")
    return ids.select(F.col("id").alias("page_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), html.alias("html"))


def land(df, folder, number, files=2):
    df.repartition(files).write.option("parquet.block.size", 1024).parquet(f"{folder}/in/batch={number}")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def run(spark, folder, limit, sink=None):
    stream = paged.stream_paged(spark, f"{folder}/in", limit, paged.PAGE)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds")
    query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{folder}/out")).start()
    try:
        counters.run_steps(query)
    finally:
        sizes = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    return sizes


def test_steps_are_bounded_and_a_restart_goes_on(spark, folder):
    first, second = rows(spark, 0, 40), rows(spark, 40, 55)
    land(first, folder, 9)
    table = paged.read_paged(spark, f"{folder}/in")
    assert table.schema.simpleString() == "struct<page_id:bigint,url:string,html:string>" and same(table, first)
    sizes = run(spark, folder, 17)
    assert sum(sizes) == 80 and max(sizes) == 17 and len(sizes) == 5
    assert run(spark, folder, 17) == []
    land(second, folder, 10)  # behind batch=9 in natural order, though not as a string
    assert run(spark, f"{folder}", 1_000) == [30]
    assert same(spark.read.parquet(f"{folder}/out"), first.union(second))


def test_a_failed_step_is_read_again(spark, folder):
    land(rows(spark, 0, 30), folder, 0)
    seen = []

    def sink(batch, number):
        seen.append((number, sorted(r.page_id for r in batch.collect())))
        if number == 1 and len(seen) == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, folder, 25, sink)
    run(spark, folder, 7, sink)  # another rate must not change the step that was planned before
    assert seen[1] == seen[2] and [n for n, _ in seen] == [0, 1, 1, 2, 3]
    assert sorted(x for n, ids in seen[:1] + seen[2:] for x in ids) == sorted(2 * list(range(30)))


def test_incomplete_landings_wait_and_late_names_are_an_error(spark, folder):
    land(rows(spark, 0, 5), folder, 1)
    land(rows(spark, 5, 9), folder, 2)
    os.rename(f"{folder}/in/batch=2/_SUCCESS", f"{folder}/later")
    assert run(spark, folder, 100) == [10]
    os.rename(f"{folder}/later", f"{folder}/in/batch=2/_SUCCESS")
    assert run(spark, folder, 100) == [8]
    land(rows(spark, 9, 10), folder, 0)
    with pytest.raises(Exception, match="have changed"):
        run(spark, folder, 100)


def test_columns_by_name_and_empty_folders(spark, folder):
    os.makedirs(f"{folder}/in")
    assert paged.read_paged(spark, f"{folder}/in", paged.PAGE).count() == 0
    with pytest.raises(Exception, match="state a schema"):
        paged.read_paged(spark, f"{folder}/in").count()
    assert run(spark, folder, 10) == []
    more = spark.createDataFrame([(1, "x", "2020-01-02 03:04:05", 7)], "page_id long, url string, t string, HTML2 int")
    land(more.withColumn("t", F.col("t").cast("timestamp")), folder, 0, files=1)
    land(rows(spark, 2, 3), folder, 1, files=1)
    read = paged.read_paged(spark, f"{folder}/in", "html string, t timestamp, page_id int").orderBy("page_id")
    assert [(r.html and len(r.html), str(r.t), r.page_id) for r in read.collect()] == [
        (None, "2020-01-02 03:04:05", 1), (50_000, "None", 2), (50_000, "None", 2)]
    with pytest.raises(ValueError, match="at least 1"):
        paged.PagedTable({"path": folder, "rowsPerTrigger": "0"}).streamReader(None)


def test_counters_are_stored_by_trigger(spark, folder):
    land(rows(spark, 0, 20), folder, 0)
    listener = counters.TriggerCounters(spark, f"{folder}/counters", "pages")
    spark.streams.addListener(listener)
    try:
        stream = paged.stream_paged(spark, f"{folder}/in", 15, paged.PAGE)
        seen = stream.observe("pages", F.count(F.lit(1)).alias("n"), F.count_if(F.col("html").isNull()).alias("empty"))
        writer = seen.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        query = writer.trigger(processingTime="0 seconds").start()
        counters.run_steps(query)
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    stored = counters.read_counters(spark, f"{folder}/counters").orderBy("batch").collect()
    assert [(r.batch, r.n) for r in stored] == [(0, 15), (1, 15), (2, 10)] and sum(r.empty for r in stored) == 8


def test_a_landing_for_steps_has_row_groups_of_a_step(spark, tmp_path):
    paged.land(spark.range(0, 2_500, 1, 1), str(tmp_path / "in/batch=0"), 1_000)
    folder = paged._Folder(str(tmp_path / "in"))
    assert [folder.groups(f.path) for _, _, f, _ in folder.after(paged.START)] == [[1_000, 1_000, 500]]


def test_a_trigger_leaves_one_file(spark, tmp_path):
    """A trigger's counters are one small task; with as many tasks as cores, storing them fell behind the triggers."""
    listener = counters.TriggerCounters(spark, str(tmp_path / "counters"), "items")
    for batch in (7, 7):
        progress = SimpleNamespace(observedMetrics={"items": Row(seen=5, share=0.5, dropped=None)}, numInputRows=5, batchId=batch, runId="r")
        listener.onQueryProgress(SimpleNamespace(progress=progress))
    assert listener.failure is None
    assert len([f for f in os.listdir(tmp_path / "counters/batch=7") if f.startswith("part-")]) == 1
    stored = counters.read_counters(spark, str(tmp_path / "counters"))
    assert dict(stored.dtypes)["seen"] == "bigint" and [(r.seen, r.share, r.batch) for r in stored.collect()] == [(5, 0.5, 7)]
