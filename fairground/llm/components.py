"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fairground.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every id in ``edges`` (``a``, ``b``; loops and repeats allowed).

    Each step hangs neighbours on the smallest one of them, which keeps the number of edges linear; the steps end when
    nothing changes, after about log(n) rounds. Minima are combined map-side, so a node with very many neighbours is
    no hot group there, and the joins that hand them back may be split. Each round is checkpointed.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        large = both.join(least, a == F.col("u")).where("b > a AND b <> m").select(b.alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "u"), a == F.col("u"))
        edges = cut_lineage(
            small.where("b <> m").select(b.alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(a.alias("id"), b.alias("component")).unionByName(
                edges.select(b.alias("id"), b.alias("component")).distinct()
            )
        before = now
