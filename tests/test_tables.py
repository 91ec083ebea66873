"""Write-side operators, versioned tables, the streaming ingest, search fallbacks and the plug-ins."""

import json

import pytest
from pyspark.sql import functions as F

from fairground.operators import curation, enrich, filters, vector
from fairground.operators.filters import SearchFilters
from fairground.schemas import CONTENT, EVENTS, PERSON, PERSON_EVENT
from fairground.sources import sinks, versions
from fairground.streaming import ingest, progress

ITEM = {"uuid": "u1", "title": "Gala", "venue": "Hall", "date": "2026 Mart 05", "price": "100", "source": "s", "scraped_at": "2026-01-01T10:00:00"}


def land(folder, name, *items):
    (folder / name).write_text("\n".join(json.dumps({**ITEM, **i}) for i in items))


def run(spark, tmp_path, **options):
    items = ingest.read_items(spark, str(tmp_path / "in"))
    as_of = F.lit("2026-01-01").cast("timestamp")
    q = ingest.ingest_stream(items, str(tmp_path / "out"), str(tmp_path / "cp"), "spider", as_of=as_of, **options)
    q.awaitTermination()
    return q


def events(spark, tmp_path):
    return {r.uuid: r for r in versions.current(spark, str(tmp_path / "out/events"), EVENTS, "uuid").collect()}


@pytest.mark.parametrize("stateful", [False, True])
def test_ingest(spark, tmp_path, stateful):
    (tmp_path / "in").mkdir()
    land(tmp_path / "in", "1.json", {"reviews": [{"content_type": "user_review", "text": "good show", "author": "A"}], "rating": 4.5, "rating_count": 7,
                                     "extracted_entities": [{"name": "P", "role": "WROTE"}, {"name": "Q", "role": "ADAPTED"}]},
         {"uuid": "u2", "title": " Gala ", "scraped_at": "2026-01-01T11:00:00"}, {"uuid": "u3", "title": ""}, {"uuid": "u4", "date": "2026 Mart 06", "venue": None})
    q = run(spark, tmp_path, stateful=stateful)
    seen = [p["observedMetrics"]["ingest"] for p in q.recentProgress if p["observedMetrics"]]
    assert sum(m["dropped"] for m in seen) == 1
    assert set(events(spark, tmp_path)) == {"u1", "u4"}
    first = events(spark, tmp_path)["u1"]
    assert str(first.event_date) == "2026-03-05" and first.price == 100.0 and first.category == "Etkinlik"

    # Same checkpoint: a repeated key, a new key and a price update arrive; earlier files are not read again.
    land(tmp_path / "in", "2.json", {"uuid": "u5"}, {"uuid": "u6", "title": "Other"}, {"is_update_job": True, "price": "55", "scraped_at": "2026-01-02T00:00:00"},
         {"uuid": "nobody", "title": "x", "is_update_job": True, "price": "1"})
    run(spark, tmp_path, stateful=stateful)
    run(spark, tmp_path, stateful=stateful)
    now = events(spark, tmp_path)
    assert set(now) == {"u1", "u4", "u6"} and now["u1"].price == 55.0 and now["u1"].title == "Gala"

    content = versions.current(spark, str(tmp_path / "out/content"), CONTENT, "uuid")
    assert {(r.event_uuid, r.content_type) for r in content.collect()} == {("u1", "user_review"), ("u1", "platform_rating")}
    people = versions.current(spark, str(tmp_path / "out/people"), PERSON, "uuid")
    assert [r.name for r in people.collect()] == ["P"]
    assert versions.read_log(spark, str(tmp_path / "out/person_event"), PERSON_EVENT).count() == 1
    dropped = versions.read_log(spark, str(tmp_path / "out/rejected"), ingest.REJECTED)
    assert {r.reject_reason for r in dropped.collect()} == {"Missing title", "Invalid relationship type: ADAPTED"}

    versions.compact(spark, str(tmp_path / "out/events"), str(tmp_path / "folded"), EVENTS, "uuid")
    assert {r.uuid for r in versions.read_log(spark, str(tmp_path / "folded"), EVENTS).collect()} == set(now)


def test_replay_writes_the_same_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    land(tmp_path / "in", "1.json", {}, {"uuid": "u4", "title": "B"})
    batch = spark.read.schema(ingest.ITEM).json(str(tmp_path / "in")).withColumn("reject_reason", F.lit(None).cast("string"))
    for _ in range(2):
        ingest.store_batch(batch, 0, str(tmp_path / "out"), F.lit("2026-01-01").cast("timestamp"))
    assert versions.read_log(spark, str(tmp_path / "out/events"), EVENTS).count() == 2


def test_bounded_dedup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    land(tmp_path / "in", "1.json", {}, {"uuid": "u2"})
    rows = ingest.session_dedup(ingest.read_items(spark, str(tmp_path / "in")), "1 hour")
    q = rows.writeStream.format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bounded").count() == 1


def test_reprice_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "found").mkdir()
    land(tmp_path / "in", "1.json", {})
    run(spark, tmp_path)
    land(tmp_path / "found", "1.json", {"price": "70"}, {"uuid": "nobody", "price": "1"})
    found = ingest.read_items(spark, str(tmp_path / "found"))
    progress.reprice_stream(found, str(tmp_path / "out"), str(tmp_path / "cp2"), F.lit("2026-02-01").cast("timestamp")).awaitTermination()
    now = events(spark, tmp_path)
    assert set(now) == {"u1"} and now["u1"].price == 70.0


def test_patch_sets_null(spark):
    target = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "uuid string, price double, t string")
    new = spark.createDataFrame([("a", None), ("c", 3.0)], "uuid string, price double")
    assert {tuple(r) for r in sinks.patch(target, new, ["price"]).collect()} == {("a", None, "x"), ("b", 2.0, "y")}


def test_same_as(spark):
    edges = spark.createDataFrame([], "uuid_a string, uuid_b string, score double, updated_at timestamp")
    links = spark.createDataFrame([("b", "a", 0.9), ("a", "b", 0.9)], "uuid_a string, uuid_b string, score double")
    got = sinks.upsert_same_as(edges, links, F.lit("2026-01-01").cast("timestamp")).collect()
    assert [(r.uuid_a, r.uuid_b, r.score) for r in got] == [("a", "b", 0.9)]


def test_members_overwrite_only_their_collection(spark, tmp_path):
    path = str(tmp_path / "members")
    schema = "category string, event_uuid string, rank int"
    sinks.write_members(spark.createDataFrame([("x", "1", 1), ("y", "2", 1)], schema), path)
    sinks.write_members(spark.createDataFrame([("x", "9", 1)], schema), path)
    assert {(r.category, r.event_uuid) for r in spark.read.parquet(path).collect()} == {("x", "9"), ("y", "2")}


def test_report(spark, tmp_path):
    one = spark.range(1).select(F.lit(2.5).alias("mean"))
    sinks.write_report(str(tmp_path / "r"), F.lit("2026-01-01"), F.lit(7), one, one.withColumnRenamed("mean", "rate"))
    (doc,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert doc == {"metadata": {"generated_at": "2026-01-01", "dataset_size": 7}, "statistical_analysis": {"mean": 2.5}, "anomaly_detection": {"rate": 2.5}}


def test_embeddings(spark):
    def model(batches):
        for batch in batches:
            yield batch.assign(embedding=batch["text"].map(lambda t: [float(len(t))]))[["event_uuid", "embedding"]]

    df = spark.createDataFrame([("u", "T", "V", None, "D")], "uuid string, title string, venue string, category string, description string")
    made = enrich.embed(df, model)
    assert [float(x) for x in made.first().embedding] == [float(len("T. V. . D"))]
    stored = spark.createDataFrame([("u", None, None), ("w", None, None)], "event_uuid string, embedding array<float>, updated_at timestamp")
    got = {r.event_uuid: r for r in sinks.set_embeddings(stored, made, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got["u"].embedding and got["w"].embedding is None and got["w"].updated_at is None


VECTORS = [("u1", [1.0, 0.0]), ("u2", [0.9, 0.1]), ("u3", [0.0, 1.0]), ("u4", [0.0, 0.0]), ("u5", None)]


def _search_tables(spark):
    ev = spark.createDataFrame([(u, t, "V", 10.0, d, "Ankara") for u, t, d in (("u1", "jazz", "d2"), ("u2", "jazz", "d1"), ("u3", "rock", "d3"))],
                               "uuid string, title string, venue string, price double, date string, city string")
    su = spark.createDataFrame([("u1", "a jazz night", 8.0), ("u2", "more jazz", 2.0), ("u3", "loud", 0.0)],
                               "event_uuid string, sentiment_summary string, quality_score double")
    ve = spark.createDataFrame(VECTORS, "id string, embedding array<float>")
    qu = spark.createDataFrame([("q", "jazz", [1.0, 0.0])], "query_id string, query string, embedding array<float>")
    return ev, su, ve, qu


def test_search(spark):
    ev, su, ve, qu = _search_tables(spark)
    (hit,) = vector.hybrid_search(ev, su, ve, qu, SearchFilters(city="ankara")).collect()
    assert (hit.title, hit.id, hit.dates, hit.score) == ("jazz", "u1", ["d1", "d2"], 1.0)
    assert "d1 to d2 (2 shows)" in vector.context_rows(vector.hybrid_search(ev, su, ve, qu, SearchFilters())).first().line
    none = vector.hybrid_search(ev, su, ve, qu, SearchFilters(max_price=1.0))  # nothing matches: filter relaxed
    assert none.count() == 1
    assert [r.id for r in vector.vector_top_k(ve, qu, 2).orderBy("rank").collect()] == ["u1", "u2"]
    ids = ve.filter("id <> 'u1'").select("id")
    assert vector.vector_top_k(ve, qu, 1, prefilter=ids).first().id == "u2"


def test_rerank_fallbacks(spark):
    rows = [("q", i, 0.9 - i / 10, i + 1) for i in range(5)]
    hits = spark.createDataFrame(rows, "query_id string, id int, score double, rank int")
    rejected_all = vector.accept_reranked(hits.withColumn("relevance", F.lit(0.1)))
    assert sorted(r.id for r in rejected_all.collect()) == [0, 1, 2]
    bad_reply = vector.accept_reranked(hits.withColumn("relevance", F.lit(None).cast("double")))
    assert bad_reply.count() == 5
    some = vector.accept_reranked(hits.withColumn("relevance", F.when(F.col("id") == 4, 0.7)))
    assert [(r.id, r.score) for r in some.collect()] == [(4, 0.7)]


def test_many_queries_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_CHUNK", 2)
    ve = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, embedding array<float>")
    qu = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id int, embedding array<float>")
    got = vector.vector_top_k(ve, qu, 3).collect()
    assert len(got) == 15 and {r.query_id for r in got} == set(range(5))


def test_tournament_filter(spark):
    ev, su, ve, qu = _search_tables(spark)

    def keep(pdf):
        return pdf[pdf["title"] == "jazz"]

    won = curation.tournament(qu.select("query_id", "embedding"), ve, ev, su, keep).collect()
    assert [(r.category, r.event_uuid, r["rank"]) for r in won] == [("q", "u1", 1)]  # u2 fails the quality gate


def test_filters(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 0.0), (4, None)], "id int, quality_score double")
    assert sorted(r.id for r in filters.quality_gate(df).collect()) == [1, 3, 4]
    assert filters.search_filter(df, SearchFilters()).count() == 4


def test_a_price_batch_reads_no_event(spark, tmp_path, monkeypatch):
    """Patches lie over older rows, newer rows over patches; unknown keys stay unknown and a replay changes nothing."""
    log = str(tmp_path / "out/events")
    old, new = "TIMESTAMP '2026-01-01'", "TIMESTAMP '2026-03-01'"
    sql = f"SELECT * FROM VALUES ('a', 'A', 1.0D, {old}), ('b', 'B', 2.0D, {new}), ('c', 'C', 3.0D, CAST(NULL AS TIMESTAMP)) t(uuid, title, price, updated_at)"
    versions.write_batch(ingest.fill(spark.sql(sql), EVENTS), log, 0)
    found = spark.sql("SELECT uuid, '70' AS price, CAST(NULL AS STRING) AS category_prices, TIMESTAMP '2026-01-01' AS scraped_at FROM VALUES ('a'), ('b'), ('c'), ('x') t(uuid)")
    (tmp_path / "out/events.patches/batch=0/_temporary/0").mkdir(parents=True)  # a first batch that failed leaves no patch
    assert versions.current(spark, log, EVENTS, "uuid").count() == 3
    with monkeypatch.context() as m:
        m.setattr(versions, "read_log", None)
        m.setattr(versions, "current", None)
        for _ in range(2):
            progress.reprice_batch(found, 0, str(tmp_path / "out"), F.lit("2026-02-01").cast("timestamp"))
    rows = versions.current(spark, log, EVENTS, "uuid").select("uuid", "title", "price").collect()
    assert {tuple(r) for r in rows} == {("a", "A", 70.0), ("b", "B", 2.0), ("c", "C", 70.0)}
    versions.compact(spark, log, str(tmp_path / "folded"), EVENTS, "uuid")
    assert {tuple(r) for r in versions.read_log(spark, str(tmp_path / "folded"), EVENTS).select("uuid", "title", "price").collect()} == {tuple(r) for r in rows}
