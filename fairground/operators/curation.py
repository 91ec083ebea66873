"""Curated collections: candidates per criterion, chunked filtering, finals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from fairground.operators.filters import quality_gate
from fairground.operators.ranks import row_numbers
from fairground.operators.vector import vector_top_k

ChunkFilter = Callable[[pd.DataFrame], pd.DataFrame]


def chunk(df: DataFrame, size: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``chunk``: consecutive groups of ``size`` rows by the unique numeric ``order``, at any table size."""
    numbered = row_numbers(df, order, by, "_n")
    return numbered.withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def candidates(
    criteria: DataFrame, vectors: DataFrame, events: DataFrame, summary: DataFrame, k: int = 50, fallback: int = 200,
) -> DataFrame:
    """Events per criterion: nearest summaries above the quality gate; criteria left empty take the ``fallback`` best
    scored of the events that pass it, with score 0. ``criteria`` is (query_id, embedding)."""
    scored = quality_gate(summary).select(F.col("event_uuid").alias("id"), "quality_score", "sentiment_summary")
    detail = events.withColumnRenamed("uuid", "id").join(scored, "id")
    near = vector_top_k(vectors, criteria, k).join(detail, "id")
    empty = criteria.select("query_id").join(near.select("query_id"), "query_id", "left_anti")
    best = detail.orderBy(F.desc_nulls_last("quality_score"), "id").limit(fallback)
    # ``best`` holds at most ``fallback`` rows, which travel as one array; each empty criterion gets all of them.
    order = W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("quality_score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).withColumn("score", F.lit(0.0))
    pool = ranked.agg(F.collect_list(F.struct(*ranked.columns)).alias("pool"))
    spare = empty.withColumn("_pool", pool.scalar()).select("query_id", F.inline("_pool"))
    return near.select(*near.columns).unionByName(spare.select(*near.columns))


def filter_chunks(rows: DataFrame, keep: ChunkFilter, size: int = 50) -> DataFrame:
    """First stage: the caller's filter sees each criterion's candidates in chunks of ``size``."""
    chunked = rows.withColumn("chunk", F.floor((F.col("rank") - 1) / size).cast("int"))
    return chunked.groupBy("query_id", "chunk").applyInPandas(keep, chunked.schema).drop("chunk")


def finals(rows: DataFrame, k: int = 10, order: str = "score") -> DataFrame:
    """Second stage: the ``k`` best per criterion, ranked from 1, with a reason."""
    best = W.partitionBy("query_id").orderBy(F.desc(order), F.asc("id"))
    ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    reason = F.format_string("Ranked #%d with score %.3f", "rank", order)
    return ranked.select(F.col("query_id").alias("category"), F.col("id").alias("event_uuid"), "rank", reason.alias("reason"))


def tournament(
    criteria: DataFrame, vectors: DataFrame, events: DataFrame, summary: DataFrame,
    keep: ChunkFilter | None = None, k: int = 10, limit: int = 50,
) -> DataFrame:
    """(category, event_uuid, rank, reason) winners of every criterion, ready for ``sinks.replace_members``."""
    pool = candidates(criteria, vectors, events, summary, limit)
    return finals(filter_chunks(pool, keep) if keep else pool, k)
