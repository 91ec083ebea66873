"""Vector retrieval, hybrid search and curated collections over the supplied tables.

Queries are the mean vectors of the embedding labels; an embedding belongs to the document of the same number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from fairground.functions import replies, text
from fairground.operators import curation, normalize, rollups, vector, vector_index
from fairground.operators.filters import SearchFilters
from fairground.plans import bindings as b
from fairground.plans.bindings import rounded, with_sql
from fairground.plans.registry import query
from fairground.session import scratch_folder
from fairground.sources.tables import read_table


def vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def topic_queries(spark, sf):
    """(query_id, query, embedding): mean vector per label."""
    rows = read_table(spark, sf, "embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    means = rows.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("v"))
    return means.select(F.col("label").alias("query_id"), F.lit("de from src").alias("query"), vector_to_array("v").alias("embedding"))


_TOPICS = """
t AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM (
        SELECT label, i, avg(CAST(x AS DOUBLE)) AS x
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY label, i) GROUP BY label),
sim AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score
        FROM t, embeddings)"""


def _top(k: int, source: str = "sim") -> str:
    return f"""
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source}
        QUALIFY rank <= {k})"""


@query("v01_vector_top_k", with_sql(_TOPICS, _top(100)) + "SELECT query_id, id, round(score, 6) AS score, rank FROM top")
def v01(spark, sf):
    return rounded(vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 100), score=6)


@query("v01_approximate_top_k")
def v01_approximate(spark, sf):
    center = topic_queries(spark, sf).orderBy("query_id").first()["embedding"]
    return vector.approximate_top_k(vectors(spark, sf), center, 10)


@query("v01_approximate_recall", "SELECT label AS query_id, true AS found_most FROM embeddings GROUP BY label")
def v01_recall(spark, sf):
    """Whether the approximate search finds at least 9 of each topic's 10 nearest; one search per topic."""
    stored, topics = vectors(spark, sf), topic_queries(spark, sf)
    near = [
        vector.approximate_top_k(stored, t["embedding"], 10).select(F.lit(t["query_id"]).alias("query_id"), "id")
        for t in topics.collect()  # as many as there are labels
    ]
    found = reduce(lambda a, b: a.unionByName(b), near).withColumn("hit", F.lit(1))
    exact = vector.vector_top_k(stored, topics, 10).select("query_id", "id")
    return exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") >= 9).alias("found_most"))


# The same searches on a stored index of cells.

_CELLS, _FINE, _TOPIC_PROBES, _PROBES = 16, 64, 48, 40


def _indexed(spark, sf, cells=_CELLS):
    return vector_index.build_index(vectors(spark, sf), scratch_folder(spark, "index"), cells)


@query("v01_index_exact", with_sql(_TOPICS, _top(100)) + "SELECT query_id, id, round(score, 6) AS score, rank FROM top")
def v01_index_exact(spark, sf):
    """All cells probed."""
    found = vector_index.search(spark, _indexed(spark, sf), topic_queries(spark, sf), 100, _CELLS)
    return rounded(found, score=6).select("query_id", "id", "score", "rank")


@query("v02_index_floor", with_sql(_TOPICS, _top(100)) + """
SELECT query_id, id, round(score, 6) AS score, rank FROM top WHERE score >= 0.25""")
def v02_index(spark, sf):
    found = vector_index.search(spark, _indexed(spark, sf), topic_queries(spark, sf), 100, _CELLS, vector.MIN_VECTOR_SCORE)
    return rounded(found, score=6).select("query_id", "id", "score", "rank")


@query("v01_index_recall", """
SELECT count(DISTINCT label) AS queries, count(DISTINCT label) * 10 AS wanted, true AS found_most FROM embeddings""")
def v01_index_recall(spark, sf):
    """Whether three of four cells hold at least 0.9 of all topics' ten nearest. Means lie between the cells."""
    topics = topic_queries(spark, sf)
    found = vector_index.search(spark, _indexed(spark, sf, _FINE), topics, 10, _TOPIC_PROBES)
    return _found_most(vector_index.recall(found, vector.vector_top_k(vectors(spark, sf), topics, 10)))


@query("v01_index_neighbours", "SELECT count(*) AS queries, count(*) * 10 AS wanted, true AS found_most FROM embeddings")
def v01_index_neighbours(spark, sf):
    """Every vector as a query: whether five of eight cells hold at least 0.9 of all ten nearest."""
    everyone = vectors(spark, sf).withColumnRenamed("id", "query_id")
    index = _indexed(spark, sf, _FINE)
    found, exact = (vector_index.search(spark, index, everyone, 10, n) for n in (_PROBES, _FINE))
    return _found_most(vector_index.recall(found, exact))


def _found_most(met):
    enough = F.sum("hits") >= 0.9 * F.sum("wanted")
    return met.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), enough.alias("found_most"))


@query("v02_score_floor", with_sql(_TOPICS, _top(100)) + """
SELECT query_id, id, round(score, 6) AS score, rank FROM top WHERE score >= 0.25""")
def v02(spark, sf):
    found = vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 100, vector.MIN_VECTOR_SCORE)
    return rounded(found, score=6)


_EN = "allowed AS (SELECT * FROM sim WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars <= 5000))"


@query("j06_prefiltered_hits", with_sql(_TOPICS, _EN, _top(10, "allowed")) + """
SELECT query_id, id, round(score, 6) AS score, rank FROM top""")
def j06(spark, sf):
    allowed = b.articles(spark, sf).filter("category = 'en' AND price <= 5000").select(F.col("uuid").alias("id"))
    return rounded(vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 10, prefilter=allowed), score=6)


@query("j06_index_prefiltered", with_sql(_TOPICS, _EN, _top(10, "allowed")) + """
SELECT query_id, id, round(score, 6) AS score, rank FROM top""")
def j06_index(spark, sf):
    allowed = b.articles(spark, sf).filter("category = 'en' AND price <= 5000").select(F.col("uuid").alias("id"))
    found = vector_index.search(spark, _indexed(spark, sf), topic_queries(spark, sf), 10, _CELLS, prefilter=allowed)
    return rounded(found, score=6).select("query_id", "id", "score", "rank")


@query("j09_hits_with_events", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _top(50)) + """
SELECT query_id, id, title, price, category, venue, quality_score, round(score, 6) AS score
FROM top JOIN articles ON uuid = id JOIN reviews ON event_uuid = id""")
def j09(spark, sf):
    hits = vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 50)
    scores = b.reviews(spark, sf).select(F.col("event_uuid").alias("id"), "quality_score")
    found = hits.join(b.articles(spark, sf).withColumnRenamed("uuid", "id"), "id").join(scores, "id")
    return rounded(found, score=6).select("query_id", "id", "title", "price", "category", "venue", "quality_score", "score")


@query("j13_hit_details", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _top(10)) + """
SELECT query_id, id, title, venue, price, sentiment_summary AS summary
FROM top JOIN articles ON uuid = id LEFT JOIN reviews ON event_uuid = id""")
def j13(spark, sf):
    hits = vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 10)
    found = vector.hit_details(hits, b.articles(spark, sf), b.reviews(spark, sf))
    return found.select("query_id", "id", "title", "venue", "price", "summary")


@query("t05_best_hits", with_sql(_TOPICS, _top(10)) + "SELECT query_id, id, rank FROM top")
def t05(spark, sf):
    return vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 10).select("query_id", "id", "rank")


FILTERS = SearchFilters(max_price=5000, category="EN")


def _search(spark, sf, **options):
    events = b.articles(spark, sf).withColumn("date", F.col("uuid").cast("string"))
    return vector.hybrid_search(events, b.reviews(spark, sf), vectors(spark, sf), topic_queries(spark, sf), FILTERS, **options)


# Every word of the query is scored against 'lang from source' plus the summary text.
_SEARCH = """
hits AS (SELECT * FROM allowed WHERE score >= 0.25
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 100),
short AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits QUALIFY rank <= 10),
det AS (SELECT query_id, id, score, rank, title, venue, price, sentiment_summary AS summary,
               string_split_regex(lower(concat_ws(' ', title, sentiment_summary)), '[^\\p{L}\\p{N}]+') AS words
        FROM short JOIN articles ON uuid = id LEFT JOIN reviews ON event_uuid = id),
rel AS (SELECT *, (list_contains(words, 'de')::INT + list_contains(words, 'from')::INT
                   + list_contains(words, 'src')::INT) / 3 AS relevance FROM det),
win AS (SELECT *, count(*) FILTER (relevance >= 0.4) OVER (PARTITION BY query_id) AS ok FROM rel),
acc AS (SELECT * REPLACE (CASE WHEN ok > 0 THEN relevance ELSE score END AS score) FROM win
        WHERE CASE WHEN ok > 0 THEN relevance >= 0.4 ELSE rank <= 3 END),
grp AS (SELECT query_id, title, venue, max(score) AS score, list_sort(list(DISTINCT CAST(id AS VARCHAR))) AS dates,
               arg_min(id, rank) AS id, arg_min(price, rank) AS price FROM acc GROUP BY query_id, title, venue),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, venue NULLS FIRST) AS rank
        FROM grp QUALIFY rank <= 10)"""


@query("v03_hybrid_search", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _EN, _SEARCH) + """
SELECT query_id, rank, title, venue, round(score, 6) AS score, array_to_string(dates, ',') AS dates, id, price FROM fin""")
def v03(spark, sf):
    found = rounded(_search(spark, sf), score=6).withColumn("dates", F.array_join("dates", ","))
    return found.select("query_id", "rank", "title", "venue", "score", "dates", "id", "price")


@query("v03_hybrid_search_postfilter", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _top(100), _EN.replace("FROM sim", "FROM top").replace("SELECT *", "SELECT query_id, id, score"), _SEARCH) + """
SELECT query_id, rank, title, venue, round(score, 6) AS score, id FROM fin""")
def v03_post(spark, sf):
    return rounded(_search(spark, sf, prefilter=False), score=6).select("query_id", "rank", "title", "venue", "score", "id")


@query("v04_rerank", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _EN, _SEARCH) + """
SELECT query_id, id, round(relevance, 6) AS relevance FROM rel""")
def v04(spark, sf):
    allowed = b.articles(spark, sf).filter("category = 'en' AND price <= 5000").select(F.col("uuid").alias("id"))
    queries = topic_queries(spark, sf)
    hits = vector.vector_top_k(vectors(spark, sf), queries, 10, vector.MIN_VECTOR_SCORE, allowed)
    detailed = vector.hit_details(hits, b.articles(spark, sf), b.reviews(spark, sf)).join(
        queries.select("query_id", "query"), "query_id"
    )
    return rounded(vector.overlap_scorer(detailed), relevance=6).select("query_id", "id", "relevance")


@query("p18_accept_reranked", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _top(10)) + """
, s AS (SELECT query_id, id, score, rank, quality_score / 10 AS relevance FROM top LEFT JOIN reviews ON event_uuid = id),
c AS (SELECT *, count(relevance) OVER w AS n, count(*) FILTER (relevance >= 0.8) OVER w AS ok FROM s
      WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, rank, round(CASE WHEN ok > 0 THEN relevance ELSE score END, 6) AS score FROM c
WHERE CASE WHEN n = 0 THEN true WHEN ok > 0 THEN coalesce(relevance >= 0.8, false) ELSE rank <= 3 END""")
def p18(spark, sf):
    hits = vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 10)
    scores = b.reviews(spark, sf).select(F.col("event_uuid").alias("id"), (F.col("quality_score") / 10).alias("relevance"))
    kept = vector.accept_reranked(hits.join(scores, "id", "left"), floor=0.8)
    return rounded(kept, score=6).select("query_id", "id", "rank", "score")


@query("a29_group_hits", with_sql(b.ARTICLES, _TOPICS, _top(50)) + """
, g AS (SELECT query_id, title, venue, max(score) AS score, count(DISTINCT id) AS n_dates, arg_min(id, rank) AS id
        FROM top JOIN articles ON uuid = id GROUP BY query_id, title, venue)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, venue) AS rank, title, venue,
       round(score, 6) AS score, n_dates, id FROM g QUALIFY rank <= 10""")
def a29(spark, sf):
    hits = vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 50)
    events = b.articles(spark, sf).withColumn("date", F.col("uuid").cast("string"))
    grouped = vector.group_hits(vector.hit_details(hits, events, b.reviews(spark, sf)))
    grouped = rounded(grouped, score=6).withColumn("n_dates", F.size("dates").cast("long"))
    return grouped.select("query_id", "rank", "title", "venue", "score", "n_dates", "id")


@query("a30_date_span", """
SELECT user_id, CASE WHEN count(DISTINCT d) > 1 THEN min(d) || ' to ' || max(d) || ' (' || count(DISTINCT d) || ' shows)'
  ELSE min(d) END AS span
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS d FROM events) GROUP BY user_id""")
def a30(spark, sf):
    days = read_table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct()
    grouped = days.groupBy("user_id").agg(F.sort_array(F.collect_list("d")).alias("dates"))  # distinct days of one user
    return grouped.select("user_id", text.date_span(F.col("dates"), F.get("dates", 0)).alias("span"))


@query("v10_context_rows", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _EN, _SEARCH) + """
SELECT query_id, rank, '- ' || title || ' @ ' || venue || ' (' || CASE WHEN len(dates) > 1
  THEN list_min(dates) || ' to ' || list_max(dates) || ' (' || len(dates) || ' shows)' ELSE CAST(fin.id AS VARCHAR) END
  || ', ' || CAST(price AS VARCHAR) || ' TL): ' || coalesce(sentiment_summary, 'null') AS line
FROM fin LEFT JOIN reviews ON event_uuid = fin.id WHERE rank <= 7""")
def v10(spark, sf):
    return vector.context_rows(_search(spark, sf))


@query("v09_route_intent", """
SELECT conv_id, turn, CASE
  WHEN regexp_matches(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}](stand-up|stand up|standup|stand-up comedy|komedi|jazz|caz|rock|pop|classical|klasik|classical music|theater|theatre|tiyatro|play|drama|dram|concert|konser|opera|ballet|bale)[^\\p{L}\\p{N}]') THEN 'search'
  WHEN regexp_matches(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}](cheap|value|affordable)[^\\p{L}\\p{N}]') THEN 'best-value'
  WHEN regexp_matches(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}](romantic|date)[^\\p{L}\\p{N}]') THEN 'date-night'
  WHEN regexp_matches(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}](weekend)[^\\p{L}\\p{N}]') THEN 'this-weekend'
  WHEN regexp_matches(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}](hidden|unique|niche)[^\\p{L}\\p{N}]') THEN 'hidden-gems'
  ELSE 'search' END AS intent FROM conversations""")
def v09(spark, sf):
    turns = read_table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", vector.route_intent(F.col("text")).alias("intent"))


@query("v05_tournament", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _top(50)) + """
, pool AS (SELECT query_id, id, score FROM top JOIN reviews ON event_uuid = id
           WHERE quality_score IS NULL OR quality_score = 0 OR quality_score >= 3)
SELECT query_id AS category, id AS event_uuid, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM pool QUALIFY rank <= 10""")
def v05(spark, sf):
    topics = topic_queries(spark, sf)
    won = curation.tournament(topics, vectors(spark, sf), b.articles(spark, sf), b.reviews(spark, sf))
    return won.select("category", "event_uuid", "rank")


@query("t08_fallback_candidates", with_sql(b.ARTICLES, b.REVIEWS, _TOPICS, _top(50)) + """
, ok AS (SELECT event_uuid AS id, quality_score FROM reviews JOIN articles ON uuid = event_uuid
         WHERE quality_score IS NULL OR quality_score = 0 OR quality_score >= 3),
nt AS (SELECT query_id, id FROM top JOIN ok USING (id) WHERE query_id < 5),
best AS (SELECT id FROM ok ORDER BY quality_score DESC NULLS LAST, id LIMIT 200)
SELECT query_id, id FROM nt
UNION ALL SELECT query_id, id FROM (SELECT DISTINCT label AS query_id FROM embeddings) q, best
WHERE query_id NOT IN (SELECT query_id FROM nt)""")
def t08(spark, sf):
    """All topics; those from 5 on have no usable vector, so they fall back."""
    topics = topic_queries(spark, sf)
    topics = topics.withColumn("embedding", F.when(F.col("query_id") < 5, F.col("embedding")).otherwise(F.transform("embedding", lambda x: x * 0)))
    out = curation.candidates(topics, vectors(spark, sf), b.articles(spark, sf), b.reviews(spark, sf))
    return out.select("query_id", "id")


@query("w04_last_turns", """
SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")
def w04(spark, sf):
    return rollups.last_n(read_table(spark, sf, "conversations"), 6, "turn", "conv_id").select("conv_id", "turn", "role")


@query("w05_chunks", """
SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 50 AS chunk FROM documents""")
def w05(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    return curation.chunk(docs, 50, "doc_id", ["lang"]).select("doc_id", "chunk")


@query("w06_ranks", with_sql(_TOPICS, _top(10)) + "SELECT query_id AS category, id AS event_uuid, rank FROM top")
def w06(spark, sf):
    hits = vector.vector_top_k(vectors(spark, sf), topic_queries(spark, sf), 10)
    return curation.finals(hits).select("category", "event_uuid", "rank")


@query("p12_compact_summary", with_sql(b.REVIEWS) + """
SELECT event_uuid, quality_score, importance, sentiment_summary AS sentiment, 2 AS n_highlights, 0 AS n_concerns,
       2 AS n_best_for, quality_score >= 8 AS bucket_list FROM reviews""")
def p12(spark, sf):
    stored = b.reviews(spark, sf).withColumns({
        "key_highlights": F.to_json(F.array("importance", F.lit("x"))), "concerns": F.lit("not json"),
        "best_for": F.concat_ws(",", "importance", F.lit("y")), "vibe": F.lit(None).cast("string"),
        "uniqueness": F.lit(None).cast("string"), "educational_value": F.lit(False),
        "tourist_attraction": F.lit(False), "bucket_list_worthy": F.col("quality_score") >= 8,
    })
    flat = normalize.compact_summary(stored)
    return flat.select("event_uuid", "quality_score", "importance", "sentiment", F.size("highlights").alias("n_highlights"),
                       F.size("concerns").alias("n_concerns"), F.size("best_for").alias("n_best_for"),
                       F.col("special_flags.bucket_list").alias("bucket_list"))


@query("f14_refine_category", """
SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'Concert' ELSE lang END AS category FROM documents""")
def f14(spark, sf):
    proposed = F.when(F.col("source").isin("src1", "src2"), "Concert").otherwise(F.col("source"))
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", replies.refine_category(F.col("lang"), proposed).alias("category"))
