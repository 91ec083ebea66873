"""Fuzzy linking of near-identical titles inside a block (same date and city, or same date and venue).

No block is compared all against all, and no block is gathered in one task:

1. Rows with the same lower-cased title in a block collapse to one representative (the smallest key). Copies link
   to it directly, so a block of identical titles costs one row each instead of one per pair.
2. Representatives become candidates only when they share one of their rare character pairs. For every metric there
   is a least number of character pairs two titles must share to reach the threshold, so a title needs to be indexed
   under only its few rarest ones; the rest cannot hide a match. The filter is exact, not approximate.
3. An index entry shared by very many titles is split into salted parts sized from its counted frequency.
4. Only candidates are scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fairground.functions.similarity import edit_ratio, seq_ratio
from fairground.session import cut_lineage

HOT = 2_000  # titles under one index entry that one task may pair up


@dataclass(frozen=True)
class Metric:
    """A similarity and what reaching threshold ``t`` implies, for titles of ``la`` and ``lb`` characters.

    ``shorter``: least length ratio shorter / longer. ``shared``: least number of common character pairs (bigrams,
    counted with multiplicity).
    """

    name: str

    def score(self, a: Column, b: Column) -> Column:
        return seq_ratio(a, b) if self.name == "ratio" else edit_ratio(a, b)

    def shorter(self, t: float) -> float:
        # ratio = 2M / (la + lb) and M <= min(la, lb); edits >= difference of the lengths.
        return t / (2 - t) if self.name == "ratio" else t

    def shared(self, t: float, la: Column, lb: Column) -> Column:
        if self.name == "ratio":
            # M matched characters in k blocks share M - k pairs. Blocks are kept apart by unmatched characters, so
            # k <= la + lb - 2M + 1, and 2M >= t (la + lb).
            return (la + lb) * (1.5 * t - 1) - 1
        # One edit destroys at most two of the max(la, lb) - 1 pairs, and there are at most (1 - t) max edits.
        return F.greatest(la, lb) * (1 - 2 * (1 - t)) - 1

    def least_shared(self, t: float, la: Column) -> Column:
        """``shared`` against the least favourable admissible partner of a title of ``la`` characters."""
        return self.shared(t, la, la * self.shorter(t))


RATIO, LEVENSHTEIN = Metric("ratio"), Metric("levenshtein")


def _metric(name: str) -> Metric:
    return {"ratio": RATIO, "levenshtein": LEVENSHTEIN}[name]


def representatives(df: DataFrame, block: Sequence[Column], title: str = "title", key: str = "uuid") -> DataFrame:
    """(block, title, uuid, rep): every row with the smallest key carrying its lower-cased title in its block."""
    complete = None
    for c in block:
        complete = c.isNotNull() if complete is None else complete & c.isNotNull()
    rows = df.filter(complete & (F.col(title) != "")).select(
        F.struct(*[c.alias(f"b{i}") for i, c in enumerate(block)]).alias("block"),
        F.lower(title).alias("title"),
        F.col(key).alias("uuid"),
    )
    reps = rows.groupBy("block", "title").agg(F.min("uuid").alias("rep"))
    return rows.join(reps, ["block", "title"])


def _numbered_pairs(title: Column) -> Column:
    """Character pairs of a title, each with its occurrence number so that repeats count: 'aaa' -> aa#1, aa#2."""
    n = F.length(title)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(at, lambda i: F.substring(title, i, F.lit(2)))
    return F.transform(
        grams,
        lambda g, i: F.concat(
            g, F.lit("#"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda h: h == g)).cast("string")
        ),
    )


def _index(reps: DataFrame, metric: Metric, threshold: float) -> DataFrame:
    """(block, gram, frequency, rep, title, len): each title under its rarest pairs.

    Titles so short that no common pair is guaranteed (``least`` below 1) go under all their pairs and under ''.
    """
    least = F.ceil(metric.least_shared(threshold, F.col("len")) - 1e-9)
    titles = reps.withColumn("len", F.length("title")).withColumn("least", least)
    grams = titles.withColumn("gram", F.explode(_numbered_pairs(F.col("title"))))
    grams = grams.unionByName(titles.filter(F.col("least") < 1).withColumn("gram", F.lit("")))
    frequency = grams.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("frequency"))
    ranked = grams.join(frequency, ["block", "gram"]).groupBy("block", "rep", "title", "len", "least").agg(
        F.array_sort(F.collect_list(F.struct("frequency", "gram"))).alias("grams")  # at most one title's length
    )
    # A match shares ``least`` pairs, so one of them is among all but the last least - 1 in any common order.
    n = F.size("grams")
    kept = F.slice("grams", F.lit(1), F.least(n, n - F.col("least") + 1).cast("int"))
    return ranked.select("block", "rep", "title", "len", F.explode(kept).alias("g")).select(
        "block", "g.gram", "g.frequency", "rep", "title", "len"
    )


def candidates(reps: DataFrame, metric: Metric, threshold: float) -> DataFrame:
    """Pairs of representatives (rep_a < rep_b) that may reach the threshold; no pair that does is missing."""
    index = _index(reps, metric, threshold)
    parts = F.greatest(F.ceil(F.col("frequency") / HOT), F.lit(1)).cast("int")
    left = index.withColumn("salt", F.pmod(F.xxhash64("rep"), parts).cast("int")).select(
        "block", "gram", "salt", F.col("rep").alias("rep_a"), F.col("title").alias("title_a"), F.col("len").alias("len_a")
    )
    right = index.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "block", "gram", "salt", F.col("rep").alias("rep_b"), F.col("title").alias("title_b"), F.col("len").alias("len_b")
    )
    la, lb = F.col("len_a"), F.col("len_b")
    near = F.least(la, lb) >= F.greatest(la, lb) * metric.shorter(threshold) - 1e-9
    met = left.join(right, ["block", "gram", "salt"]).filter((F.col("rep_a") < F.col("rep_b")) & near)
    return met.select("block", "rep_a", "title_a", "rep_b", "title_b").dropDuplicates(["block", "rep_a", "rep_b"])


def _scored(reps: DataFrame, metric: Metric, threshold: float, strict: bool) -> DataFrame:
    only = reps.filter(F.col("uuid") == F.col("rep")).select("block", "title", "rep")
    found = candidates(only, metric, threshold)
    scored = found.withColumn("score", metric.score(F.col("title_a"), F.col("title_b")))
    passed = F.col("score") > threshold if strict else F.col("score") >= threshold
    return scored.filter(passed)


def link_similar(
    df: DataFrame,
    block: Sequence[Column],
    threshold: float = 0.85,
    metric: str = "ratio",
    title: str = "title",
    key: str = "uuid",
) -> DataFrame:
    """(uuid_a, uuid_b, score) links inside each block, uuid_a < uuid_b.

    Between different titles there is one link per pair of representatives; every further copy of a title links to
    its representative with score 1. That is the all-pairs result without its repeats: two rows match exactly when
    their representatives are linked (or are the same), with that score.
    """
    reps = representatives(df, block, title, key)
    between = _scored(reps, _metric(metric), threshold, strict=False).select(
        F.col("rep_a").alias("uuid_a"), F.col("rep_b").alias("uuid_b"), "score"
    )
    copies = reps.filter(F.col("uuid") != F.col("rep")).select(
        F.col("rep").alias("uuid_a"), F.col("uuid").alias("uuid_b"), F.lit(1.0).alias("score")
    )
    return between.unionByName(copies)


def _greedy_leaders(edges: DataFrame) -> DataFrame:
    """Consumed nodes with their leader under 'a row not yet consumed consumes its later neighbours, in key order'.

    A row leads when none of its earlier neighbours leads. Each round settles every row without an open earlier
    neighbour at once, so the number of rounds is the longest chain of dependent decisions, not the block size.
    Reads (src < dst) edges; runs one job per round and keeps each round's state in the checkpoint folder.
    """
    edges = cut_lineage(edges)
    open_edges, consumed = edges, None
    while not open_edges.isEmpty():
        settled = open_edges.select("src").join(open_edges.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
        taken = cut_lineage(open_edges.join(settled, "src", "left_semi").select("dst").distinct())
        consumed = taken if consumed is None else consumed.unionByName(taken)
        rest = open_edges.join(taken, "dst", "left_anti").join(taken.withColumnRenamed("dst", "src"), "src", "left_anti")
        open_edges = cut_lineage(rest)
    if consumed is None:
        return edges.limit(0)
    # Every row that was not consumed leads, also one whose own edges all vanished on the way.
    led = edges.join(consumed.withColumnRenamed("dst", "src"), "src", "left_anti")
    first = led.groupBy("dst").agg(F.min_by(F.struct("src", "score"), "src").alias("p"))
    return first.select("p.src", "dst", "p.score")


def duplicate_pairs(
    df: DataFrame,
    block: Sequence[Column],
    threshold: float = 0.8,
    metric: str = "ratio",
    title: str = "title",
    key: str = "uuid",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Greedy duplicates: in key order, a row not yet consumed consumes its later near-identical rows in the block.

    Returns (uuid_a, title_a, uuid_b, title_b, similarity) with similarity above the threshold, one row per consumed
    row, titles as they are stored, and ``<name>_a``, ``<name>_b`` of every column in ``carry`` (the price, say). Runs
    jobs (one per round of decisions).
    """
    reps = representatives(df, block, title, key)
    between = _scored(reps, _metric(metric), threshold, strict=True)
    taken = _greedy_leaders(between.select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst"), "score"))
    # Copies follow their representative: to its leader, or to itself when it leads.
    members = reps.select("uuid", "rep").alias("m")
    joined = members.join(taken.alias("t"), F.col("m.rep") == F.col("t.dst"), "left").select(
        F.coalesce("t.src", "m.rep").alias("uuid_a"), F.col("m.uuid").alias("uuid_b"),
        F.coalesce("t.score", F.lit(1.0)).alias("similarity"),
    ).filter(F.col("uuid_a") != F.col("uuid_b"))
    for side in ("a", "b"):
        shown = [F.col(c).alias(f"{c}_{side}") for c in carry]
        joined = joined.join(df.select(F.col(key).alias(f"uuid_{side}"), F.col(title).alias(f"title_{side}"), *shown), f"uuid_{side}")
    extra = [f"{c}_{side}" for c in carry for side in ("a", "b")]
    return joined.select("uuid_a", "title_a", "uuid_b", "title_b", "similarity", *extra)


def duplicate_totals(pairs: DataFrame, high: float = 0.95) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("similarity") > high).alias("high_confidence")
    )


def duplicate_examples(pairs: DataFrame, n: int = 20) -> DataFrame:
    return pairs.orderBy("uuid_a", "uuid_b").limit(n)
