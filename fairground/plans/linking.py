"""Fuzzy linkage over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairground.functions.similarity import edit_ratio, seq_ratio
from fairground.operators import linkage
from fairground.plans.registry import query
from fairground.sources.tables import read_table

_BLOCK = ("brand", "type")


def parts(spark, sf):
    """Parts as events; brand and type stand for the date and the place."""
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("uuid"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"),
    )


def _block():
    return [F.col(c) for c in _BLOCK]


_REPS = """
WITH r AS (SELECT p_brand AS brand, p_type AS type, lower(p_name) AS title, min(p_partkey) AS rep FROM part GROUP BY ALL),
s AS (SELECT a.rep AS uuid_a, b.rep AS uuid_b,
             1 - levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title)) AS score
      FROM r a JOIN r b ON a.brand = b.brand AND a.type = b.type AND a.rep < b.rep)
"""

# The ratio counts the characters of common blocks: the longest one (the earliest in a, then in b), then those left and
# right of it, and so on. A code is 1000 * length - place of the longest block that begins at a place of a.
_BLOCKS = """
x AS (SELECT id, a, b, 0::BIGINT AS matched FROM t
      UNION ALL SELECT id, unnest([substr(a, 1, i - 1), substr(a, i + k)]), unnest([substr(b, 1, j - 1), substr(b, j + k)]), unnest([k, 0])
      FROM (SELECT *, strpos(b, substr(a, i, k)) AS j
            FROM (SELECT *, 1000 * k - code AS i
                  FROM (SELECT *, (code + 999) // 1000 AS k
                        FROM (SELECT id, a, b, list_max(list_transform(range(1, length(a) + 1), lambda i:
                                1000 * coalesce(list_max(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n)))), 0) - i)) AS code
                              FROM x WHERE a <> '' AND b <> '')) WHERE k > 0))),
m AS (SELECT id, 2.0::DOUBLE * sum(matched)::DOUBLE AS twice FROM x GROUP BY id)
"""

_RATIO_REPS = """
WITH RECURSIVE r AS (SELECT p_brand AS brand, p_type AS type, lower(p_name) AS title, min(p_partkey) AS rep FROM part GROUP BY ALL),
t AS MATERIALIZED (SELECT struct_pack(uuid_a := a.rep, uuid_b := b.rep) AS id, a.title AS a, b.title AS b
      FROM r a JOIN r b ON a.brand = b.brand AND a.type = b.type AND a.rep < b.rep),
""" + _BLOCKS + """
, s AS (SELECT id.uuid_a AS uuid_a, id.uuid_b AS uuid_b, twice / (length(a) + length(b)) AS score FROM t JOIN m USING (id))
"""


@query("j10_link_similar_levenshtein", _REPS + """
SELECT uuid_a, uuid_b, round(score, 6) AS score FROM s WHERE score >= 0.8
UNION ALL SELECT rep, p_partkey, 1.0 FROM part JOIN r ON brand = p_brand AND type = p_type AND title = lower(p_name)
WHERE p_partkey <> rep""")
def j10_levenshtein(spark, sf):
    links = linkage.link_similar(parts(spark, sf), _block(), 0.8, "levenshtein")
    return links.withColumn("score", F.round("score", 6))


@query("j10_link_similar", _RATIO_REPS + """
SELECT uuid_a, uuid_b, score FROM s WHERE score >= 0.85
UNION ALL SELECT rep, p_partkey, 1.0::DOUBLE FROM part JOIN r ON brand = p_brand AND type = p_type AND title = lower(p_name)
WHERE p_partkey <> rep""")
def j10(spark, sf):
    return linkage.link_similar(parts(spark, sf), _block(), 0.85)


# In key order, a title leads when no earlier leader is like it; the others follow the first leader that is.
_PICKS = """
, nb AS (SELECT uuid_b AS rep, list(uuid_a) AS nb FROM s WHERE score > 0.8 GROUP BY 1),
n AS (SELECT brand, type, rep, row_number() OVER (PARTITION BY brand, type ORDER BY rep) AS i, coalesce(nb, []) AS nb
      FROM r LEFT JOIN nb USING (rep)),
g AS (SELECT DISTINCT brand, type, 0::BIGINT AS i, []::BIGINT[] AS lead FROM r
      UNION ALL SELECT g.brand, g.type, n.i, CASE WHEN list_has_any(n.nb, g.lead) THEN g.lead ELSE list_append(g.lead, n.rep) END
      FROM g JOIN n ON g.brand = n.brand AND g.type = n.type AND n.i = g.i + 1),
l AS (SELECT unnest(arg_max(lead, i)) AS rep FROM g GROUP BY brand, type),
f AS (SELECT uuid_b AS rep, min(uuid_a) AS src, arg_min(score, uuid_a) AS score FROM s SEMI JOIN l ON l.rep = uuid_a
      WHERE score > 0.8 AND uuid_b NOT IN (SELECT rep FROM l) GROUP BY 1),
d AS (SELECT coalesce(src, r.rep) AS uuid_a, p_partkey AS uuid_b, coalesce(score, 1.0) AS similarity
      FROM part JOIN r ON brand = p_brand AND type = p_type AND title = lower(p_name) LEFT JOIN f ON f.rep = r.rep
      WHERE coalesce(src, r.rep) <> p_partkey)
"""
_GREEDY = _REPS.replace("WITH r", "WITH RECURSIVE r") + _PICKS
_RATIO_GREEDY = _RATIO_REPS + _PICKS


@query("j11_duplicate_pairs", _RATIO_GREEDY + """
SELECT uuid_a, a.p_name AS title_a, uuid_b, b.p_name AS title_b, similarity, a.p_retailprice AS price_a, b.p_retailprice AS price_b
FROM d JOIN part a ON a.p_partkey = uuid_a JOIN part b ON b.p_partkey = uuid_b""")
def j11(spark, sf):
    return linkage.duplicate_pairs(parts(spark, sf), _block(), 0.8, carry=("price",))


@query("j11_duplicate_pairs_levenshtein", _GREEDY + """
SELECT uuid_a, a.p_name AS title_a, uuid_b, b.p_name AS title_b, round(similarity, 6) AS similarity,
       a.p_retailprice AS price_a, b.p_retailprice AS price_b
FROM d JOIN part a ON a.p_partkey = uuid_a JOIN part b ON b.p_partkey = uuid_b""")
def j11_levenshtein(spark, sf):
    pairs = linkage.duplicate_pairs(parts(spark, sf), _block(), 0.8, "levenshtein", carry=("price",))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("d13_duplicate_totals_levenshtein", _GREEDY + """
SELECT count(*) AS total, count(*) FILTER (similarity > 0.95) AS high_confidence FROM d""")
def d13_levenshtein(spark, sf):
    return linkage.duplicate_totals(linkage.duplicate_pairs(parts(spark, sf), _block(), 0.8, "levenshtein"))


@query("d13_duplicate_totals", _RATIO_GREEDY + """
SELECT count(*) AS total, count(*) FILTER (similarity > 0.95) AS high_confidence FROM d""")
def d13(spark, sf):
    return linkage.duplicate_totals(linkage.duplicate_pairs(parts(spark, sf), _block(), 0.8))


@query("f15_edit_ratio", """
SELECT l_orderkey AS uuid, l_linenumber AS line, round(1 - levenshtein(lower(p_name), lower(p_type))
       / greatest(length(p_name), length(p_type)), 6) AS score FROM lineitem JOIN part ON p_partkey = l_partkey""")
def f15_edit(spark, sf):
    lines, named = read_table(spark, sf, "lineitem"), read_table(spark, sf, "part")
    joined = lines.join(named, lines.l_partkey == named.p_partkey)
    score = F.round(edit_ratio(F.col("p_name"), F.col("p_type")), 6)
    return joined.select(F.col("l_orderkey").alias("uuid"), F.col("l_linenumber").alias("line"), score.alias("score"))


@query("f15_seq_ratio", """
WITH RECURSIVE t AS MATERIALIZED (SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b FROM part),
""" + _BLOCKS + """
SELECT id AS uuid, twice / (length(a) + length(b)) AS score FROM t JOIN m USING (id)""")
def f15_ratio(spark, sf):
    score = seq_ratio(F.col("p_name"), F.col("p_type"))
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("uuid"), score.alias("score"))
