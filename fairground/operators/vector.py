"""Vector retrieval and hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fairground.functions import text
from fairground.functions.places import GENRES
from fairground.functions.similarity import token_overlap
from fairground.operators.filters import SearchFilters, search_filter

MIN_VECTOR_SCORE = 0.25
MIN_RERANK_SCORE = 0.4

# So many queries may travel to the tasks as one matrix of a few megabytes.
QUERY_CHUNK = 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in the JVM, for pairs that are already joined; null for a zero vector."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, zero, lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score descending, id ascending."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _partial_top_k(matrix, query_ids: list, k: int, floor: float | None):
    """Per-partition top k of every query: one matrix product per Arrow batch, at most k rows kept per query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = matrix.value
        kept = [(np.empty(0), np.empty(0, dtype=object))] * len(query_ids)
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            if batch.empty:
                continue
            vectors = np.stack(batch["embedding"].to_numpy()).astype("float64")
            norms = np.linalg.norm(vectors, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = (queries @ vectors.T) / norms
            ids = batch["id"].to_numpy()
            for i in range(len(query_ids)):
                good = np.isfinite(scores[i]) if floor is None else scores[i] >= floor
                s, d = np.concatenate([kept[i][0], scores[i][good]]), np.concatenate([kept[i][1], ids[good]])
                at = _best(s, d, k)
                kept[i] = (s[at], d[at])
        for query_id, (s, d) in zip(query_ids, kept):
            if len(s):
                yield pd.DataFrame({"query_id": [query_id] * len(s), "id": d, "score": s})

    return run


def vector_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 100, floor: float | None = None, prefilter: DataFrame | None = None,
) -> DataFrame:
    """Exact cosine top ``k`` of every query: (query_id, id, score, rank); ties by id.

    ``vectors`` is (id, embedding), ``queries`` is (query_id, embedding); ``prefilter`` keeps only its ids. The
    vectors are scanned in place and never shuffled: each task keeps k rows per query, and only those are ranked. That
    takes ``QUERY_CHUNK`` queries, which are sent along. More of them stay a DataFrame and meet the vectors in blocks.
    """
    if prefilter is not None:
        vectors = vectors.join(prefilter.select("id"), "id", "left_semi")
    vectors = vectors.select("id", "embedding")
    kinds = {**dict(vectors.dtypes), **dict(queries.dtypes)}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    context = vectors.sparkSession.sparkContext
    chunk = queries.select("query_id", "embedding").limit(QUERY_CHUNK + 1).collect()
    if len(chunk) > QUERY_CHUNK:
        return _many_top_k(vectors, queries, k, floor, schema)
    if not chunk:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    matrix = np.array([r["embedding"] for r in chunk], dtype="float64")
    matrix /= np.where((n := np.linalg.norm(matrix, axis=1, keepdims=True)) == 0, np.nan, n)
    run = _partial_top_k(context.broadcast(matrix), [r["query_id"] for r in chunk], k, floor)
    # k rows per task and query, then k per slice and query: the last step ranks at most 64 k rows per query however
    # many tasks scanned the vectors.
    order = (F.desc("score"), F.asc("id"))
    found = vectors.mapInPandas(run, schema).withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (("query_id", "_slice"), ("query_id",)):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found.drop("_slice")


def _many_top_k(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None, schema: str) -> DataFrame:
    """Blocks of queries against parts of the vectors; nothing but counts comes to the driver."""
    from fairground.operators import vector_index

    one = F.lit(0).alias("cell")
    stored = vector_index.directions(vectors, "id").select("id", "embedding", one)
    asked = vector_index.directions(queries, "query_id").select("query_id", "embedding", one)
    found = vector_index.score_by_blocks(stored, asked, {0: asked.count()}, k, floor, schema)
    return vector_index.rank_hits(found, k)


def approximate_top_k(vectors: DataFrame, query: list[float], k: int, bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """Approximate neighbours of one query by random projections; recall below 1. (id, score)"""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select("id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=1)
    near = lsh.fit(rows).approxNearestNeighbors(rows, Vectors.dense(query), k)
    return near.select("id", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))


def hit_details(hits: DataFrame, events: DataFrame, summary: DataFrame) -> DataFrame:
    """Hits with their event and summary columns."""
    e = events.withColumnRenamed("uuid", "id")
    s = summary.select(F.col("event_uuid").alias("id"), F.col("sentiment_summary").alias("summary"))
    return hits.join(e, "id").join(s, "id", "left")


Scorer = Callable[[DataFrame], DataFrame]


def overlap_scorer(hits: DataFrame) -> DataFrame:
    """Default relevance: share of query words found in title or summary. Adds ``relevance``."""
    searched = F.concat_ws(" ", "title", "summary")
    return hits.withColumn("relevance", token_overlap(F.col("query"), searched))


def accept_reranked(hits: DataFrame, floor: float = MIN_RERANK_SCORE, fallback: int = 3) -> DataFrame:
    """Keep hits the scorer finds relevant, with their new score.

    When the scorer rejects all hits of a query, its best ``fallback`` originals stay; when it scored none (a bad
    reply), all originals stay. Windows run over the few hits of each query.
    """
    w = W.partitionBy("query_id")
    ok = F.coalesce(F.col("relevance") >= floor, F.lit(False))
    scored, accepted = F.count("relevance").over(w), F.count_if(ok).over(w)
    marked = hits.withColumns({"_ok": ok, "_scored": scored, "_accepted": accepted})
    keep = (
        F.when(F.col("_scored") == 0, F.lit(True))
        .when(F.col("_accepted") > 0, F.col("_ok")).otherwise(F.col("rank") <= fallback)
    )
    score = F.when(F.col("_accepted") > 0, F.col("relevance")).otherwise(F.col("score"))
    return marked.filter(keep).withColumn("score", score).drop("_ok", "_scored", "_accepted")


def group_hits(hits: DataFrame, k: int = 10) -> DataFrame:
    """Merge hits on (title, venue): best score, distinct dates ascending, details of the first; top k per query."""
    groups = hits.groupBy("query_id", "title", "venue").agg(
        F.max("score").alias("score"),
        F.sort_array(F.collect_set("date")).alias("dates"),
        F.min_by(F.struct("id", "price", "date", "summary"), F.struct("rank", "id")).alias("first"),
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("title"), F.asc_nulls_first("venue"))
    ranked = groups.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "title", "venue", "score", "dates", "first.*")


def hybrid_search(
    events: DataFrame,
    summary: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    filters: SearchFilters,
    k: int = 100,
    shortlist: int = 10,
    scorer: Scorer = overlap_scorer,
    prefilter: bool = True,
) -> DataFrame:
    """Filter, retrieve, re-rank, group: the ten best (title, venue) groups per query.

    ``queries`` is (query_id, query, embedding). Filters that match nothing fall away. With ``prefilter`` the
    neighbours are taken among matching events; without it matches are picked from the global top ``k``, which can
    lose some.
    """
    matching = search_filter(events, filters).select(F.col("uuid").alias("id"))
    if filters.is_empty():
        hits = vector_top_k(vectors, queries, k, MIN_VECTOR_SCORE)
    elif prefilter:
        hits = vector_top_k(vectors, queries, k, MIN_VECTOR_SCORE, matching)
    else:
        hits = vector_top_k(vectors, queries, k, MIN_VECTOR_SCORE).join(matching, "id", "left_semi")
    again = W.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= shortlist)
    detailed = hit_details(hits, events, summary).join(queries.select("query_id", "query"), "query_id")
    return group_hits(accept_reranked(scorer(detailed)))


def context_rows(groups: DataFrame, k: int = 7) -> DataFrame:
    """Answer context: '- title @ venue (dates, price TL): summary' for the best groups of each query."""
    when = text.date_span(F.col("dates").cast("array<string>"), F.col("date").cast("string"))
    line = F.format_string(
        "- %s @ %s (%s, %s TL): %s", "title", "venue", when, F.col("price").cast("string"), "summary"
    )
    return groups.filter(F.col("rank") <= k).select("query_id", "rank", line.alias("line"))


# Collection slugs a general request is routed to. Words are tried in this order.
INTENTS = (
    ("best-value", ("cheap", "value", "affordable")),
    ("date-night", ("romantic", "date")),
    ("this-weekend", ("weekend",)),
    ("hidden-gems", ("hidden", "unique", "niche")),
)


def route_intent(query: Column) -> Column:
    """Slug of the collection a general request asks for, 'search' for a specific or unrecognised one."""
    low = F.lower(query)

    def mentions(words) -> Column:
        return low.rlike(r"(?<![\p{L}\p{N}])(" + "|".join(words) + r")(?![\p{L}\p{N}])")

    route = F.when(mentions(GENRES), "search")
    for slug, words in INTENTS:
        route = route.when(mentions(words), slug)
    return route.otherwise("search")
