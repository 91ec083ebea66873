"""A stored index for vector search: an inverted file of cells.

Centroids are fitted by k-means on a bounded sample of the vectors (``SAMPLE`` rows at most, by a hash of the id, so a
refit on the same rows agrees). Every vector, not only the sample, is written to the partition of its nearest centroid,
scaled to length 1. A search joins each query with its nearest cells and reads just those partitions; candidates are
scored exactly. Probing all cells is the exact search.

The centroids (``cells`` vectors) travel to the tasks as one small matrix, whose size is checked. Queries stay a
DataFrame: they are joined with their cells and meet the cells' vectors in groups of bounded size on both sides, and no
vector passes through the driver. A hot cell (all vectors alike, or all queries) is many such groups.

Defined cases: null and zero vectors, and those with a null or non-finite component, have no direction and are neither
indexed nor found; a query like that finds nothing; fewer vectors than cells give as many cells as there are distinct
sampled vectors; equal scores go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SAMPLE = 100_000  # rows the centroids are fitted on, at most
MOST_CENTROID_BYTES = 64 << 20
PART_ROWS = 16_384  # vectors of a cell in one task's group
FILE_ROWS = 1_000_000
QUERY_ROWS = 1024  # queries scored against a part at a time
BLOCK_ROWS = 65_536  # queries of a cell in one task's group


@dataclass(frozen=True)
class Index:
    """Where an index is stored; ``open_index`` reads what else there is to know."""

    path: str
    id_type: str
    cells: int


def usable(v: Column) -> Column:
    """A direction: all components finite and one of them not 0."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once: a lambda's argument is, while a column that a lambda names is evaluated
    again for each element."""
    return F.get(F.transform(F.array(c), use), 0)


def _unit(v: Column) -> Column:
    """The vector at length 1, scaled by its largest component first so that no square overflows."""

    def to_length(scaled: Column) -> Column:
        length = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x * x))
        return _once(length, lambda n: F.transform(scaled, lambda x: x / n))

    top = F.array_max(F.transform(v, F.abs))
    return _once(_once(top, lambda t: F.transform(v, lambda x: x / t)), to_length)


def directions(df: DataFrame, key: str) -> DataFrame:
    rows = df.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(usable(F.col("embedding"))).withColumn("embedding", _unit(F.col("embedding")))


def fit_centroids(vectors: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """k-means on at most ``SAMPLE`` rows of (id, embedding), those with the smallest hashes of their ids."""
    rows = directions(vectors, "id")
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    # a hash under this share of its range keeps about SAMPLE rows; the limit makes it a bound
    share = min(1.0, 0.95 * SAMPLE / n)
    bound = int((share * 2 - 1) * (2**63 - 1)) if share < 1 else 2**63 - 1
    sample = rows.where(F.xxhash64("id") <= bound).limit(SAMPLE).select(array_to_vector("embedding").alias("features")).persist()
    try:
        return np.array(KMeans(k=max(1, cells), seed=seed, maxIter=12, initSteps=2).fit(sample).clusterCenters())
    finally:
        sample.unpersist()


def nearest_cells(centroids: np.ndarray, n: int):
    """An Arrow function adding ``cell``: one row for each of a vector's ``n`` nearest centroids."""
    half = (centroids**2).sum(axis=1) / 2  # nearest by distance: the greatest x.c - |c|^2 / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            near = vectors @ centroids.T - half
            if n < near.shape[1]:
                cells = np.argpartition(-near, n - 1, axis=1)[:, :n]
            else:
                cells = np.broadcast_to(np.arange(near.shape[1]), near.shape)
            which = np.repeat(np.arange(batch.num_rows), cells.shape[1])
            taken = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.ravel().astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def build_index(vectors: DataFrame, path: str, cells: int = 256, seed: int = 7) -> Index:
    """Fit, assign and store (id, embedding) by cell."""
    centroids = fit_centroids(vectors, cells, seed)
    if centroids.nbytes > MOST_CENTROID_BYTES:
        raise ValueError(f"{cells} cells of {centroids.shape[1]} dimensions are more than {MOST_CENTROID_BYTES} bytes")
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["id"]
    stored = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    stored.coalesce(1).write.parquet(f"{path}/centroids")
    placed = assign(directions(vectors, "id"), centroids, 1, f"id {kind}, embedding array<double>")
    # one shuffle by cell and a salt: a cell is one file, a hot one several, each written by a task of its own
    files = _per_cell(_sizes(placed), FILE_ROWS).cast("long")
    spread = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.nullif(files, F.lit(0).cast("long"))))
    spread.repartition("cell", "salt").drop("salt").write.partitionBy("cell").parquet(f"{path}/vectors")
    return Index(path, kind, len(centroids))


def assign(rows: DataFrame, centroids: np.ndarray, n: int, schema: str) -> DataFrame:
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema + ", cell int")
    return rows.mapInArrow(nearest_cells(centroids, n), schema + ", cell int")


def open_index(spark: SparkSession, path: str, id_type: str) -> Index:
    return Index(path, id_type, spark.read.parquet(f"{path}/centroids").count())


def _centroids(spark: SparkSession, index: Index) -> np.ndarray:
    rows = spark.read.schema("cell int, centroid array<double>").parquet(f"{index.path}/centroids").orderBy("cell").collect()
    return np.array([r["centroid"] for r in rows])


def _best_of_part(k: int, floor: float | None):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Vectors of one part of a cell against the queries that probe the cell."""
        found: list[np.ndarray] = []
        scored: list[np.ndarray] = []
        if len(left) and len(right):
            matrix, ids = np.array(left["embedding"].tolist()), left["id"].to_numpy()
            order = np.argsort(ids, kind="stable")  # ties go by id
            matrix, ids = matrix[order], ids[order]
            for s in range(0, len(right), QUERY_ROWS):
                some = right.iloc[s : s + QUERY_ROWS]
                scores = np.array(some["embedding"].tolist()) @ matrix.T
                for line in scores:
                    at = np.flatnonzero(line >= floor) if floor is not None else np.arange(len(line))
                    if len(at) > k:
                        kth = np.partition(line[at], len(at) - k)[len(at) - k]
                        at = at[line[at] >= kth]
                        at = at[np.argsort(-line[at], kind="stable")[:k]]
                    found.append(ids[at])
                    scored.append(line[at])
        if not found:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        asked = np.repeat(right["query_id"].to_numpy(), [len(ids) for ids in found])
        return pd.DataFrame({"query_id": asked, "id": np.concatenate(found), "score": np.concatenate(scored)})

    return run


def search(
    spark: SparkSession,
    index: Index,
    queries: DataFrame,
    k: int = 100,
    probes: int = 8,
    floor: float | None = None,
    prefilter: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` by cosine in each query's ``probes`` nearest cells; ties by id.

    ``queries`` is (query_id, embedding), any number. ``probes`` of ``index.cells`` or more is the exact search.
    ``prefilter`` (id) keeps only its ids, before anything is ranked.
    """
    kind = dict(queries.dtypes)["query_id"]
    asked = assign(directions(queries, "query_id"), _centroids(spark, index), probes, f"query_id {kind}, embedding array<double>")
    schema = f"query_id {kind}, id {index.id_type}, score double"
    if not index.cells:
        return spark.createDataFrame([], schema + ", rank int")
    stored = spark.read.schema(f"id {index.id_type}, embedding array<double>, cell int").parquet(f"{index.path}/vectors")
    # only the partitions of cells that are asked for are read
    asked_sizes = _sizes(asked)
    stored = stored.where(F.col("cell").isin(list(asked_sizes)))
    if prefilter is not None:
        stored = stored.join(prefilter.select("id"), "id", "left_semi")
    return rank_hits(score_by_blocks(stored, asked, asked_sizes, k, floor, schema), k)


def _sizes(rows: DataFrame) -> dict[int, int]:
    """Rows per cell; one number for each of the cells."""
    return {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def _per_cell(sizes: dict[int, int], rows: int) -> Column:
    """How many groups of about ``rows`` a cell takes; 0 for a cell without any."""
    if not sizes:
        return F.lit(0)
    known = F.create_map(*[F.lit(x) for cell, n in sizes.items() for x in (cell, -(-n // rows))])
    return F.coalesce(F.element_at(known, F.col("cell")), F.lit(0))


def score_by_blocks(vectors: DataFrame, queries: DataFrame, query_sizes: dict[int, int], k: int, floor: float | None, schema: str) -> DataFrame:
    """The best ``k`` of every (part of a cell's vectors, block of its queries); both of bounded size.

    ``vectors`` is (id, embedding, cell), ``queries`` (query_id, embedding, cell), all of length 1.
    """
    parts, blocks = _per_cell(_sizes(vectors), PART_ROWS), _per_cell(query_sizes, BLOCK_ROWS)
    none = F.array().cast("array<int>")

    def mine(key: str, of: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.nullif(of, F.lit(0)).cast("long")).cast("int")

    def every(of: Column) -> Column:
        return F.explode(F.when(of > 0, F.sequence(F.lit(0), of - 1)).otherwise(none))

    left = vectors.withColumn("part", mine("id", parts)).withColumn("block", every(blocks))
    right = queries.withColumn("block", mine("query_id", blocks)).withColumn("part", every(parts))
    keys = ("cell", "part", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best_of_part(k, floor), schema)


def rank_hits(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, wanted): how many of each query's exact neighbours were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count("hit").alias("hits"), F.count("*").alias("wanted")
    )
