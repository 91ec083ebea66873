"""The stored vector index: exact mode against brute force, recall, hot cells and defined cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairground.operators import vector, vector_index

KIND = "id int, embedding array<double>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    return np.array([centres[i % 12] + rng.normal(size=24) / 3 for i in range(900)])


def brute(data, queries, k, floor=-2.0):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    out = {}
    for q, v in queries.items():
        scores = unit @ (v / np.linalg.norm(v))
        out[q] = [int(i) for i in np.lexsort((np.arange(len(scores)), -scores))[:k] if scores[i] >= floor]
    return out


def hits(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    return got


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], KIND)
    return vector_index.build_index(rows, str(tmp_path_factory.mktemp("index") / "i"), cells=12)


def asked(spark, data):
    queries = {q: data[q] for q in range(0, 900, 7)}
    return queries, spark.createDataFrame([(q, v.tolist()) for q, v in queries.items()], "query_id int, embedding array<double>")


def test_probing_all_cells_is_exact(spark, index, data):
    queries, df = asked(spark, data)
    assert hits(vector_index.search(spark, index, df, 10, probes=index.cells)) == brute(data, queries, 10)
    assert hits(vector_index.search(spark, index, df, 10, probes=99, floor=0.8)) == {q: v for q, v in brute(data, queries, 10, 0.8).items() if v}


def test_few_probes_find_most_and_read_few_cells(spark, index, data):
    queries, df = asked(spark, data)
    exact = vector_index.search(spark, index, df, 10, probes=index.cells)
    met = vector_index.recall(vector_index.search(spark, index, df, 10, probes=3), exact).agg(F.sum("hits") / F.sum("wanted")).first()[0]
    assert met >= 0.9
    one = vector_index.search(spark, index, df.limit(1), 5, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.split("PartitionFilters: [")[1].split("]")[0].count(",") <= 3


def test_every_vector_is_stored_once(spark, index):
    stored = spark.read.parquet(f"{index.path}/vectors")
    assert stored.count() == stored.select("id").distinct().count() == 900
    assert vector_index.open_index(spark, index.path, "int") == index


def test_hot_cells_are_many_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 50)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 20)
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 10 else [0.0, 1.0]) for i in range(1000)], KIND)
    index = vector_index.build_index(rows, str(tmp_path / "i"), cells=4)
    queries = spark.createDataFrame([(q, [1.0, 0.1]) for q in range(60)], "query_id int, embedding array<double>")
    assert hits(vector_index.search(spark, index, queries, 5, probes=1)) == {q: [1, 2, 3, 4, 5] for q in range(60)}
    sizes = []

    def best(k, floor):
        def run(left, right):
            return vector_index.pd.DataFrame({"query_id": [0], "id": [len(left)], "score": [float(len(right))]})

        return run

    monkeypatch.setattr(vector_index, "_best_of_part", best)
    stored = spark.read.parquet(f"{index.path}/vectors")
    near = vector_index.assign(vector_index.directions(queries, "query_id"), vector_index._centroids(spark, index), 1, "query_id int, embedding array<double>")
    groups = vector_index.score_by_blocks(stored, near, vector_index._sizes(near), 5, None, "query_id int, id int, score double").collect()
    assert max(r.id for r in groups) < 100 and max(r.score for r in groups) < 50
    assert len(groups) >= 900 / 50 * 3


def test_vectors_without_direction(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1e300, 1e300]), (8, [1e-300, 0.0]), (8, [1e-300, 0.0])]
    index = vector_index.build_index(spark.createDataFrame(rows, KIND), str(tmp_path / "i"), cells=3)
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, embedding array<double>")
    got = vector_index.search(spark, index, queries, 10, probes=9)
    assert [(r.query_id, r.id, round(r.score, 6)) for r in got.orderBy("rank").collect()] == [("q", 1, 1.0), ("q", 8, 1.0), ("q", 8, 1.0), ("q", 7, 0.707107)]
    empty = vector_index.build_index(spark.createDataFrame([], KIND), str(tmp_path / "e"), cells=3)
    assert vector_index.search(spark, empty, queries, 10).count() == 0


def test_prefilter_comes_before_ranking(spark, index, data):
    queries, df = asked(spark, data)
    allowed = spark.createDataFrame([(i,) for i in range(500, 900)], "id int")
    got = hits(vector_index.search(spark, index, df, 3, probes=index.cells, prefilter=allowed))
    assert got == {q: [i + 500 for i in v] for q, v in brute(data[500:], queries, 3).items()}


def test_many_queries_stay_a_frame(spark, data, monkeypatch):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], KIND)
    queries, df = asked(spark, data)
    few = hits(vector.vector_top_k(rows, df, 4))
    monkeypatch.setattr(vector, "QUERY_CHUNK", 10)
    assert hits(vector.vector_top_k(rows, df, 4)) == few == brute(data, queries, 4)


def test_lengths_in_time_that_grows_with_the_dimensions(spark):
    import time

    made = np.random.default_rng(3).normal(size=(100, 600)) * 1e200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "id long, embedding array<double>")
    start = time.monotonic()
    got = np.array([r.embedding for r in vector_index.directions(df, "id").orderBy("id").collect()])
    assert time.monotonic() - start < 60
    scaled = made / np.abs(made).max(axis=1, keepdims=True)
    assert np.allclose(got, scaled / np.linalg.norm(scaled, axis=1, keepdims=True))
