"""Line deduplication by content-defined chunks of lines.

A hash rolls over the hashes of two neighbouring lines. A chunk begins where it is smaller than the one before or not
larger than the one after, so boundaries depend on the lines around them only: a passage that is shifted by inserted
lines is cut in the same places. Of any two neighbouring places one is a boundary, the same one wherever their three
lines stand. A chunk is the two lines from its boundary on; it grows by the line before it and by the line after it.
As boundaries lie at most two lines apart, that covers every line of a repeated passage of three lines or more: such a
line is always cut. A passage of just two lines is found where both places have a boundary in it.

A chunk, grown or not, that occurs more than once in the corpus goes, in every occurrence but the first by document id,
text hash and position. Every distinct line stays at its first place in the corpus. Chunks meet on the 64-bit hashes of
their lines, and the bytes of all lines of equal hash are compared; should a hash stand for two different lines, chunks
with such a line stay. Lines are compared without trailing white space; blank lines belong to the line before them, so
paragraphs that are set apart differently are still copies, and blank lines at the start of a text stay.

Everything is DataFrame expressions. Only hashes travel to find repeats; lines travel once to be compared, after equal
ones were combined in each task, and whole rows travel once to meet their cuts. A chunk that a third of all documents
share is a skewed side of an inner join, which Spark splits.

Defined cases: a null text stays null and has no lines; an empty text is one blank line; rows that repeat an id and a
text are the same document and are cut alike; a document whose every line is cut keeps its row with an empty text; an
empty table gives an empty result. Columns of the input keep their names, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairground.llm.registry import query
from fairground.llm.rows import keyed, named, same_row

SPACE = " \t\n\x0b\x0c\r"
BEFORE_LINE = r"\n(?=[^\n]*[^\x20\x09-\x0D])"  # the line break before a line that isn't blank
LINES = ("l0", "l1", "l2")


def with_blanks(text: Column) -> Column:
    """The lines of a text that aren't blank, each with the blank lines after it; the first item may be blank."""
    return F.split(text, BEFORE_LINE, -1)


def bare_lines(text: Column) -> Column:
    """The lines that aren't blank, without trailing white space."""
    return F.filter(F.transform(with_blanks(text), lambda y: F.rtrim(y, F.lit(SPACE))), lambda y: y != "")


def chunk_column(text: Column) -> Column:
    """Where chunks begin: structs of ``s`` (the line, from 0) and the hashes of that line, the next, and those around."""
    # each step is a one-element transform, so that the step before is evaluated once
    hashed = F.transform(F.array(bare_lines(text)), lambda x: F.struct(
        F.transform(x, lambda y: F.xxhash64(y)).alias("l"), F.transform(x, lambda y: F.md5(y.cast("binary"))).alias("m"),
    ))
    rolled = F.transform(hashed, lambda x: F.struct(x["l"].alias("l"), F.zip_with(
        F.slice(x["m"], 1, F.greatest(F.size(x["m"]) - 1, F.lit(0))), F.slice(x["m"], 2, F.size(x["m"])),
        lambda a, b: F.md5(F.concat(a, b).cast("binary")),
    ).alias("r")))

    def begins(r: Column, i: Column) -> Column:
        here, before, after = F.get(r, i), F.get(r, i - 1), F.get(r, i + 1)
        return F.coalesce(here <= after, F.lit(False)) | F.coalesce(here < before, F.lit(False)) | (F.size(r) == 1)

    def chunks(l: Column, r: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(r) - 1, F.lit(0))), lambda i: begins(r, i))
        return F.transform(starts, lambda i: F.struct(
            i.alias("s"), F.get(l, i - 1).alias("before"), F.get(l, i).alias("l0"), F.get(l, i + 1).alias("l1"), F.get(l, i + 2).alias("after"),
        ))

    return F.flatten(F.transform(rolled, lambda x: chunks(x["l"], x["r"])))


def ambiguous_hashes(texts: DataFrame, text: str) -> DataFrame:
    """``lh``: hashes that stand for lines of different bytes."""
    lines = texts.select(F.explode(bare_lines(named(text))).alias("line")).select(F.xxhash64("line").alias("lh"), "line")
    return lines.groupBy("lh").agg(F.countDistinct("line").alias("n")).where("n > 1").select("lh")


def repeated_lines(docs: DataFrame, key: str, text: str, ambiguous: DataFrame | None = None) -> DataFrame:
    """``v_k``, ``v_t`` and ``cut``: the lines to cut from each document, counted from 0 among lines that aren't blank."""
    texts = docs.where(named(text).isNotNull())
    rows = texts.select(named(key).alias("k"), F.xxhash64(named(text)).alias("t"), F.explode(chunk_column(named(text))).alias("c")).select("k", "t", "c.*")
    again = rows.groupBy("l0", "l1").agg(F.count("*").alias("times")).where("times > 1").select("l0", "l1")
    nothing = F.lit(None).cast("long")
    grown = F.array(
        F.struct(F.col("s"), F.col("l0"), F.col("l1"), nothing.alias("l2")),
        F.when(F.col("before").isNotNull(), F.struct((F.col("s") - 1).alias("s"), F.col("before").alias("l0"), F.col("l0").alias("l1"), F.col("l1").alias("l2"))),
        F.when(F.col("after").isNotNull(), F.struct(F.col("s"), F.col("l0"), F.col("l1"), F.col("after").alias("l2"))),
    )
    chunks = rows.join(again, ["l0", "l1"]).select("k", "t", F.explode(grown).alias("c")).where("c IS NOT NULL").select("k", "t", "c.*")
    first = chunks.groupBy(*LINES).agg(F.min(F.struct("k", "t", "s")).alias("first"), F.count("*").alias("times")).where("times > 1")
    ambiguous = ambiguous_hashes(texts, text) if ambiguous is None else ambiguous
    for name in LINES:
        first = first.join(ambiguous.select(F.col("lh").alias(name)), name, "left_anti")
    first = first.select(*[F.col(name).alias(f"f_{name}") for name in LINES], "first")
    same = F.expr("l0 = f_l0 AND l1 = f_l1 AND l2 <=> f_l2 AND NOT (struct(k, t, s) <=> first)")
    later = chunks.join(first, same).select("k", "t", "s", F.when(F.col("l2").isNull(), F.col("s") + 1).otherwise(F.col("s") + 2).alias("e"))
    cuts = later.groupBy(F.col("k").alias("v_k"), F.col("t").alias("v_t")).agg(F.collect_set(F.struct("s", "e")).alias("cut"))
    return cuts.withColumn("cut", F.flatten(F.transform("cut", lambda c: F.sequence(c["s"], c["e"]))))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines cut from the text, and ``n_lines``, ``n_cut_lines`` (long)."""
    joined = keyed(docs, key, text).join(repeated_lines(docs, key, text), same_row(), "left").withColumn("body", F.col("row")[text])

    def stay(items: Column) -> Column:
        blank = F.when(F.rtrim(F.get(items, F.lit(0)), F.lit(SPACE)) == "", 1).otherwise(0)  # not counted among the lines
        gone = F.transform("cut", lambda c: c + blank)
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(items) - 1), gone), lambda i: F.get(items, i))

    split = F.transform(F.array(with_blanks(F.col("body"))), stay)
    joined = joined.withColumn("left", F.when(F.col("cut").isNotNull(), F.get(split, F.lit(0))))
    n_lines = F.when(F.col("body").isNull(), 0).otherwise(F.size(F.split("body", "\n", -1)))
    n_left = F.aggregate("left", F.lit(0), lambda a, y: a + F.size(F.split(y, "\n", -1)))
    n_cut = F.when(F.col("left").isNull(), 0).otherwise(n_lines - n_left)
    body = F.when(F.col("left").isNull(), F.col("body")).otherwise(F.array_join("left", "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_cut_lines")]
    return joined.select(
        *[body.alias(c) if c == text else F.col("row")[c].alias(c) for c in names],
        n_lines.cast("long").alias("n_lines"), n_cut.cast("long").alias("n_cut_lines"),
    )


@query("op2_line_dedup", r"""
WITH d AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
y AS MATERIALIZED (SELECT doc_id, unnest(l) AS y, unnest(range(1, len(l) + 1)) AS i FROM d WHERE text IS NOT NULL),
g AS MATERIALIZED (
  SELECT *, regexp_matches(y, '[^\x20\x09-\x0D]') AS full_line,
         sum(CASE WHEN regexp_matches(y, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM y),
b AS MATERIALIZED (SELECT doc_id, g, rtrim(y, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS a FROM g WHERE full_line),
w AS MATERIALIZED (
  SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, md5(md5(a) || md5(lead(a) OVER o)) AS r FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY g)),
s AS MATERIALIZED (SELECT *, lag(r) OVER o AS before, lead(r) OVER o AS after FROM w WHERE r IS NOT NULL WINDOW o AS (PARTITION BY doc_id ORDER BY g)),
two AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, g) AS n FROM s
  WHERE r <= after OR r < before OR (before IS NULL AND after IS NULL)),
three AS (SELECT doc_id, g, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, g) AS n FROM w WHERE c IS NOT NULL),
cut AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest([g, g + 1]) AS g FROM two WHERE n > 1
  UNION SELECT DISTINCT doc_id, unnest([g, g + 1, g + 2]) AS g FROM three WHERE n > 1),
o AS (
  SELECT g.doc_id, string_agg(CASE WHEN cut.g IS NULL THEN y END, chr(10) ORDER BY i) AS body, count(cut.g)::BIGINT AS n_cut
  FROM g LEFT JOIN cut ON g.doc_id = cut.doc_id AND g.g = cut.g GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(body, '') END AS text, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n_cut, 0)::BIGINT AS n_cut_lines
FROM d LEFT JOIN o USING (doc_id)""")  # fmt: skip
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without their repeated chunks of lines."""
    return dedup_lines(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text", "n_lines", "n_cut_lines")
