"""Exact top-k by inner product: columnar branch-and-bound.

Vectors are whole numbers (components scaled and floored). Rows are dealt to parts of bounded size; a task holds one
part in vertical layout, one line per dimension, the dimensions of most mass first, and queries stream past it in small
batches. The scores of a batch grow block by block of dimensions. After each block a candidate can gain at most the
product of both remaining lengths (Cauchy-Schwarz), and the candidates that cannot reach the k-th best score known so
far are compacted away; what is left after the last block has its exact score. The k-th best known is the least exact
score of the k candidates that lead after the first block, so it is a true lower bound and nothing is lost.

Candidates are shuffled once. The queries are a stated set, and each is sent to every part: this work is queries times
rows by nature. Parts are as large as ``MOST_COMPONENTS`` allows once every core has one, so queries are sent as rarely as
possible; the number of parts never changes a result. A part returns at most k rows per query; those of a query, k times
the number of parts, are ranked in a second grouping. No vector passes through the driver.

Scores are exact: products are summed as floats only while all sums stay below 2 ** 53, beyond that as whole numbers.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part; components whose scaled
value is beyond 2 ** 26 count as that; shorter vectors count as if followed by zeros, an empty one scores 0; equal
scores go by the smaller id, then by the row; a query's own row is left out and no other, so rows that repeat its id are
candidates, and each of them answers as a query of its own; null ids are candidates and come last among ties; fewer than
k candidates give fewer rows, a lone row none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fairground.llm.registry import query
from fairground.llm.rows import named

SCALE = 64
LARGEST = 1 << 26
BLOCK = 16  # dimensions at a time
LEAST_ROWS = 4096  # of a part: below that, more parts don't pay
MOST_COMPONENTS = 1 << 23  # of a part, counted at the longest vector's length: bounds a task's memory
CELLS = 1 << 22  # scores of a batch of queries against one part
EXACT = float(1 << 53)


def quantised(vector: Column) -> Column:
    """Whole numbers, or null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v * SCALE))).cast("int"))
    return F.when(fine, whole)


class Part:
    """Some rows in vertical layout, in the order of ties: by id, null last, then by row."""

    def __init__(self, row: np.ndarray, ids: list, vectors: list[np.ndarray]) -> None:
        tied = sorted(range(len(ids)), key=lambda j: (ids[j] is None, 0 if ids[j] is None else ids[j], row[j]))
        self.row, vectors = row[tied], [vectors[j] for j in tied]
        self.ids = np.array([ids[j] for j in tied], dtype=object)
        dims = max(map(len, vectors), default=0)
        flat = np.zeros((len(vectors), dims), np.int64)
        for i, v in enumerate(vectors):
            flat[i, : len(v)] = v
        lines = flat.T
        self.order = np.argsort(-(lines.astype(float) ** 2).sum(axis=1), kind="stable")
        self.lines = np.ascontiguousarray(lines[self.order])
        self.floats = self.lines.astype(float)
        self.starts = list(range(0, dims, BLOCK))
        self.most = float(np.abs(self.lines).max(initial=0))
        # length of what remains from each block on, a line per block
        squares = self.floats**2
        self.remaining = np.array([np.sqrt(squares[s:].sum(axis=0)) for s in self.starts])

    def _aligned(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Queries in this part's order of dimensions; its rows are zero beyond their own."""
        dims = len(self.order)
        out = np.zeros((len(vectors), dims), np.int64)
        for i, v in enumerate(vectors):
            out[i, : min(len(v), dims)] = v[:dims]
        return out[:, self.order]

    def search(self, rows: np.ndarray, vectors: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query number, positions of the k best in order, and their scores."""
        n = len(self.row)
        q = self._aligned(vectors)
        small = self.most * float(np.abs(q).max(initial=0)) * max(1, len(self.order)) < EXACT
        q, lines = (q.astype(float), self.floats) if small else (q, self.lines)
        lengths = np.array([np.sqrt((q[:, s:].astype(float) ** 2).sum(axis=1)) for s in self.starts])
        first = self.starts[0] + BLOCK if self.starts else 0
        lead = q[:, :first] @ lines[:first]
        for i in range(len(vectors)):
            partial, alive = lead[i], np.arange(n)
            own = np.flatnonzero(self.row == rows[i])
            if len(own):
                alive = np.delete(alive, own)
                partial = partial[alive]
            floor = None
            if len(alive) > k:
                leaders = alive[np.argpartition(partial, len(partial) - k)[-k:]]
                floor = (q[i] @ lines[:, leaders]).min()
            for b, start in enumerate(self.starts[1:], 1):
                if floor is not None:
                    # a hair more than the bound, for its own rounding
                    reach = partial + lengths[b, i] * self.remaining[b, alive] * (1 + 1e-9) + 1e-6
                    stay = np.flatnonzero(reach >= floor)
                    partial, alive = partial[stay], alive[stay]
                stop = start + BLOCK
                partial = partial + q[i, start:stop] @ lines[start:stop, alive]
            if len(alive) > k:
                kth = np.partition(partial, len(partial) - k)[len(partial) - k]
                stay = np.flatnonzero(partial >= kth)
                partial, alive = partial[stay], alive[stay]
            ahead = np.argsort(-partial, kind="stable")[:k]
            yield i, alive[ahead], partial[ahead].astype(np.int64)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, candidates before queries; partial results go out per batch of queries."""
        part, current = None, None
        held: tuple[list, list, list] = ([], [], [])
        kind = None
        for batch in batches:
            kind = batch.schema.field(3).type
            number, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            rows, ids = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            values, offsets = batch.column(4).flatten().to_numpy(), batch.column(4).offsets.to_numpy()
            offsets = offsets - offsets[0]
            vectors = [values[a:b] for a, b in zip(offsets, offsets[1:])]
            cuts = np.flatnonzero(np.diff(number) | np.diff(is_query.astype(np.int8))) + 1
            for a, b in zip([0, *cuts], [*cuts, len(number)]):
                if number[a] != current:
                    current, part, held = number[a], None, ([], [], [])
                if not is_query[a]:
                    held[0].append(rows[a:b]), held[1].extend(ids[a:b]), held[2].extend(v.copy() for v in vectors[a:b])
                    continue
                if part is None:
                    part = Part(np.concatenate(held[0]) if held[0] else np.zeros(0, np.int64), held[1], held[2])
                    held = ([], [], [])
                step = max(1, CELLS // max(1, len(part.row)))
                for s in range(int(a), int(b), step):
                    e = min(int(b), s + step)
                    out: tuple[list, ...] = ([], [], [], [], [])
                    for i, at, scores in part.search(rows[s:e], vectors[s:e], k):
                        out[0].extend([rows[s + i]] * len(at)), out[1].extend([ids[s + i]] * len(at))
                        out[2].extend(part.ids[at]), out[3].extend(part.row[at]), out[4].extend(scores)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], kind), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())],
                        names=["query_row", "query_id", "id", "row", "score"],
                    )

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, <key>, score`` of the ``k`` best rows for each row of ``vectors`` where ``queries`` holds."""
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), named(key).alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"),
        quantised(named(vector)).alias("v"),
    ).where("v IS NOT NULL")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    wide = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n * max(dims or 1, 1) // MOST_COMPONENTS), min(wide, -(-n // LEAST_ROWS)), 1)
    mine = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    sent = F.when(F.col("asks"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array().cast("array<int>"))
    copies = F.concat(
        F.array(F.struct(mine.alias("part"), F.lit(False).alias("is_query"))),
        F.transform(sent, lambda p: F.struct(p.alias("part"), F.lit(True).alias("is_query"))),
    )
    dealt = rows.select(F.explode(copies).alias("c"), "row", "id", "v").select("c.part", "c.is_query", "row", "id", "v")
    # by range, as hashes would put several parts into one task
    ordered = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "is_query")
    kind = dict(rows.dtypes)["id"]
    found = ordered.mapInArrow(_searched(k), f"query_row long, query_id {kind}, id {kind}, row long, score long")
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


@query("op13_top_k", """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x::DOUBLE))) = 0),
p AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, c.r AS cr, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr)::INT AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) <= 20""")  # fmt: skip
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best rows for every row whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0)
