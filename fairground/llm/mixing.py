"""Mix sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; ``target / source size`` copies of each of its documents would hit it
exactly. The whole part is taken as it is. The fraction is rounded by pairs: words are moved from one document's
probability to another's until one of the two is 0 or 1, at random and without bias, so that the expected copies stay
right and the number of words stays exactly what it was. Each task rounds one small bucket of a source and leaves at
most one document undecided; a reduction tree rounds those of ``FAN_IN`` buckets at a time until one is left per
source, which is decided by a draw. Documents with more than 1 / ``LARGE`` of their source's words (by arithmetic fewer
than ``LARGE`` of a source) are rounded before all others, each paired with the pool of all smaller ones, whose rate then
makes up for what it took, so that a source's words differ from its target by less than one of its smaller documents.

Rows with equal key, source and text are one group with a count, made map-side: its copies are rounded together and
handed out evenly, so a hot row is no hot task. Nothing is collected: buckets hold about ``BUCKET`` groups whatever a
source's size, a source with a third of all rows is many buckets, and small sources share one. Draws are seeded by
source and bucket and groups are ordered by key, size and text hash, so reruns agree.

Defined cases: a null source is a source of its own, after all others; null and empty texts have size 0, take nothing
and need no rounding; repeated rows take their group's copies, the same number each or one more; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fairground.llm.registry import query
from fairground.llm.rows import named
from fairground.session import cut_lineage

WEIGHTS = (1, 2, 3)
MOST = 3  # copies of a document
BUCKET = 4096
FAN_IN = 256
LARGE = 1000
SMALL = 1_000_000  # sources whose rates may be broadcast
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources in code point order, null last, weigh ``weights`` in turn and share all words; a target stops at ``most``
    times its source's size and the excess is shared by weight among the others. The loop settles who stops; each
    round is one aggregate whose single row of totals comes back, never the sources.
    """
    # numbered without one task for all: sorted, stored, then position in the partition plus what comes before it
    named = cut_lineage(sizes.where("source IS NOT NULL").orderBy("source")).withColumns(
        {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    before = named.groupBy("part").agg(F.count("*").alias("n")).select(
        F.col("part").alias("p"),
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"),
    )
    named = named.join(before, F.col("part") == F.col("p")).select("source", "source_size", (F.col("at") + F.col("n")).alias("nth"))
    unnamed = sizes.where("source IS NULL").select("source", "source_size", F.lit(named.count()).cast("long").alias("nth"))
    ranked = cut_lineage(named.unionByName(unnamed))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight.cast("long")).withColumn("most", F.col("source_size") * most)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # num / den: words per unit of weight for those that don't stop; whole numbers, so the order of sums can't matter
    num, den = total, None
    while True:
        stops = F.lit(False) if den is None else F.col("most") * F.lit(den) < F.col("w") * F.lit(num)
        capped, open_w = ranked.agg(
            F.sum(F.when(stops, F.col("most"))), F.sum(F.when(stops, 0).otherwise(F.col("w")))
        ).first()
        after = (total - (capped or 0), open_w or 0)
        if after == (num, den) or not after[1]:
            break
        num, den = after
    share = F.lit(float(num)) * F.col("w") / F.lit(float(den or 1))
    target = F.when(F.col("most") * F.lit(den or 1) < F.col("w") * F.lit(num), F.col("most").cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def _pivot(sizes: np.ndarray, probs: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Probabilities after rounding pair by pair; the index of the one left between 0 and 1, or -1."""
    p = probs.tolist()
    w = sizes.tolist()
    held = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        # words that can move from j to i, and from i to j
        up = min((1 - p[i]) * w[i], p[j] * w[j])
        down = min(p[i] * w[i], (1 - p[j]) * w[j])
        if draws[j] * (up + down) < down:  # each way as likely as the other way's length: no bias
            moved, full_i, full_j = up, (1 - p[i]) * w[i] <= up, p[j] * w[j] <= up
            p[i], p[j] = (1.0 if full_i else p[i] + moved / w[i]), (0.0 if full_j else p[j] - moved / w[j])
        else:
            moved, full_i, full_j = down, p[i] * w[i] <= down, (1 - p[j]) * w[j] <= down
            p[i], p[j] = (0.0 if full_i else p[i] - moved / w[i]), (1.0 if full_j else p[j] + moved / w[j])
        held = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return np.array(p), held


def _seeded(*parts: object) -> np.random.Generator:
    digest = hashlib.sha256("\x1f".join(map(repr, parts)).encode()).digest()
    return np.random.default_rng(np.frombuffer(digest, dtype=np.uint32))


def _by_node(pdf: pd.DataFrame, work) -> pd.DataFrame:
    """A cell holds one node of a large source, or the only nodes of several small ones."""
    return pd.concat([work(part.copy()) for _, part in pdf.groupby(["src", "node"], sort=True)])


def _round_leaf(seed: int):
    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size", "t"], kind="stable", na_position="last")
        rng = _seeded(seed, pdf["src"].iloc[0], int(pdf["node"].iloc[0]), 0)
        # large ones first, so that what is left undecided at the end is small
        pdf = pdf.iloc[np.lexsort((rng.permutation(len(pdf)), -pdf["size"].to_numpy()))]
        sizes = pdf["size"].to_numpy(dtype=float)
        probs = np.where(sizes > 0, pdf["p"].to_numpy(dtype=float), 0.0)
        p, held = _pivot(sizes, probs, rng.random(len(pdf)))
        pdf["p"] = p
        pdf["open"] = np.arange(len(pdf)) == held
        return pdf

    return lambda pdf: _by_node(pdf, leaf)


def _round_large(seed: int, most: int):
    """Each group of equal documents, the largest first, is paired with the pool of all smaller ones of its source: its
    fraction is rounded at random and the pool's rate takes up the difference, so its expected value stays what it was."""

    def large(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "t"], ascending=[False, True, True], kind="stable")
        rng = _seeded(seed, pdf["src"].iloc[0], -1)
        words, size, whole = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0]), []
        for own, c, draw in zip(pdf["size"].tolist(), pdf["c"].tolist(), rng.random(len(pdf)).tolist()):
            rate = c * min(max(words / size, 0.0), float(most)) if size else 0.0
            whole.append(int(rate) + (draw < rate % 1.0))
            words, size = words - whole[-1] * own, size - own * c
        pdf["whole"] = np.array(whole, dtype=np.int64)
        pdf["p"] = 0.0
        pdf["open"] = False
        return pdf

    return lambda pdf: _by_node(pdf, large)


def _round_node(level: int, seed: int):
    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "leaf"], ascending=[False, True], kind="stable")
        rng = _seeded(seed, pdf["src"].iloc[0], int(pdf["node"].iloc[0]), level)
        p, held = _pivot(pdf["size"].to_numpy(dtype=float), pdf["p"].to_numpy(dtype=float), rng.random(len(pdf)))
        if pdf["final"].iloc[0] and held >= 0:
            p[held], held = float(rng.random() < p[held]), -1
        pdf["p"] = p
        pdf["open"] = np.arange(len(pdf)) == held
        return pdf

    return lambda pdf: _by_node(pdf, node)


def group_copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                 weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """Per group of rows with equal key, source and text: key, source, t (a hash of the text), c (its rows), size,
    source_size, target and n_copies (of all its rows together). Texts are read once."""
    groups = docs.select(
        named(key).alias("key"), named(source).alias("source"), words_in(named(text)).alias("size"), F.xxhash64(named(text)).alias("t")
    ).groupBy("key", "source", "size", "t").agg(F.count("*").alias("c"))
    groups = cut_lineage(groups)
    totals = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.count("*").alias("n"))
    totals = cut_lineage(totals)
    n_groups = totals.agg(F.sum("n")).first()[0] or 0
    targets = source_targets(totals.select("source", "source_size"), weights, most)
    # null and any text as keys of plain equality
    src = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    leaves = totals.select(src.alias("src"), F.ceil(F.col("n") / BUCKET).cast("long").alias("leaves"))
    targets = cut_lineage(targets.withColumn("src", src).join(leaves, "src"))
    # one small row per source, counted: rows of a hot source needn't meet in one task
    near = F.broadcast if targets.count() <= SMALL else (lambda df: df)
    rated = groups.withColumn("src", src).join(near(targets.drop("source")), "src")
    is_large = F.col("size") * LARGE > F.col("source_size")
    whole = F.floor(F.least(F.col("rate"), F.lit(float(most))) * F.col("c"))
    # small sources share cells, so that many of them aren't as many groups
    cells = max(1, -(-n_groups // BUCKET))

    def cell(alone: Column) -> Column:
        return F.when(alone, F.xxhash64("src", "node")).otherwise(F.pmod(F.xxhash64("src"), F.lit(cells)))

    def rounded(rows: DataFrame, leaf) -> DataFrame:
        rows = rows.withColumn("whole", whole).withColumn("p", F.col("rate") * F.col("c") - F.col("whole"))
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        columns = ["key", "source", "size", "t", "c", "source_size", "target", "whole", "p", "src", "node", "leaves", "cell"]
        schema = ", ".join(f"{c} {kinds[c]}" for c in columns if c != "cell") + ", cell long, open boolean"
        rows = rows.withColumn("cell", cell(F.col("leaves") > 1))
        return cut_lineage(rows.select(*columns).groupBy("cell").applyInPandas(leaf, schema).drop("cell"))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    large = rated.where(is_large).withColumn("rate", rate).withColumn("node", F.lit(-1).cast("long"))
    large = rounded(large, _round_large(seed, most))
    spent = large.groupBy("src").agg(
        F.sum(F.col("size") * F.col("c")).alias("large_size"), F.sum(F.col("whole") * F.col("size")).alias("large_taken")
    )
    left = targets.join(spent, "src", "left").select(
        "src",
        (F.col("target") - F.coalesce("large_taken", F.lit(0))).alias("words"),
        (F.col("source_size") - F.coalesce("large_size", F.lit(0))).alias("of"),
    ).select("src", F.when(F.col("of") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("words") / F.col("of")))).otherwise(0.0).alias("rate"))
    small = rated.where(~is_large).join(near(left), "src").withColumn("node", F.pmod(F.xxhash64("key", "size", "t"), F.col("leaves")))
    first = rounded(small, _round_leaf(seed))
    undecided = first.where("open").select("src", F.col("node").alias("leaf"), "size", "p", F.lit(True).alias("open"), "leaves")
    most_leaves = targets.agg(F.max("leaves")).first()[0] or 1
    decided, level, nodes = None, 0, most_leaves
    while True:
        level, nodes = level + 1, -(-nodes // FAN_IN)
        fan = FAN_IN**level
        grouped = undecided.where("open").withColumn("node", F.floor(F.col("leaf") / F.lit(fan)).cast("long")).withColumn(
            "final", F.col("leaves") <= fan
        ).withColumn("cell", cell(~F.col("final")))
        done = grouped.groupBy("cell").applyInPandas(
            _round_node(level, seed), "src string, leaf long, size long, p double, open boolean, leaves long, node long, final boolean, cell long"
        ).drop("node", "final", "cell")
        done = cut_lineage(done)
        settled = done.where("NOT open").select("src", "leaf", F.col("p").alias("settled"))
        decided = settled if decided is None else decided.unionByName(settled)
        if nodes == 1:
            break
        undecided = done
    out = first.unionByName(large).join(
        decided.withColumnRenamed("src", "d_src"),
        F.col("open") & (F.col("src") == F.col("d_src")) & (F.col("node") == F.col("leaf")),
        "left",
    )
    n_copies = F.col("whole") + F.round(F.coalesce("settled", "p")).cast("long")
    return out.select("key", "source", "t", "c", "size", "source_size", "target", n_copies.alias("n_copies"))


def _times(df: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``nth``; in two steps, so that no array is as long as a hot group."""
    part = df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BUCKET))))
    upto = F.least(F.lit(BUCKET).cast("long"), F.col(n) - F.col("part") * BUCKET) - 1
    return part.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), upto))).withColumn(
        "nth", F.col("part") * BUCKET + F.col("at")
    ).drop("part", "at")


def copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: key, source, size, source_size, target, n_copies, taken."""
    rows = _times(group_copies(docs, key, source, text, **options), "c")
    # row r of c gets what its share adds to the whole number of copies
    n = F.expr("(nth + 1) * n_copies div c - nth * n_copies div c").cast("int")
    return rows.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", n.alias("n_copies"),
        (n * F.col("size")).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns of ``docs``.

    Only keys, sources and sizes are rounded; whole rows join their group's copies by key, source and text hash. A
    group's copies are handed out over its rows in the order of their hashes, equal rows counted together, so that they
    add up to what the group takes.
    """
    verdict = group_copies(docs, key, source, text, **options).where("n_copies > 0").select(
        F.struct("key", "source", "t").alias("v"), "c", "n_copies"
    )
    verdict = cut_lineage(verdict)
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), F.struct(
        named(key).alias("key"), named(source).alias("source"), F.xxhash64(named(text)).alias("t")).alias("v"))
    single = rows.join(verdict.where("c = 1"), "v").select("row", "n_copies")
    # equal rows meet map-side; a group's unlike rows (other columns differ) are ranked by narrow columns
    several = rows.join(verdict.where("c > 1"), "v").withColumn("h", F.xxhash64("row")).groupBy("v", "c", "n_copies", "h").agg(
        F.first("row").alias("row"), F.count("*").alias("m")
    )
    upto = F.sum("m").over(Window.partitionBy("v").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    shared = several.withColumn("upto", upto).select(
        "row", F.expr("upto * n_copies div c - (upto - m) * n_copies div c").cast("long").alias("n_copies")
    )
    return _times(single.unionByName(shared).where("n_copies > 0"), "n_copies").select("row.*")


@query("op9_mixing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Words taken of every document, its source's size and target."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    return copies(docs).select("doc_id", "size", "source_size", "target", "taken")
