"""Lookups, filters, joins, grouped lookups and write-side operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairground.functions import text
from fairground.operators import enrich, filters, normalize, relations, rollups
from fairground.operators.filters import SearchFilters
from fairground.plans import bindings as b
from fairground.plans.bindings import rounded, with_sql
from fairground.plans.registry import query
from fairground.sources import buckets, sinks
from fairground.session import scratch_folder
from fairground.sources.tables import first_rows, read_table

_LISTINGS = with_sql(b.LISTINGS)
_ARTICLE_REVIEWS = with_sql(b.ARTICLES, b.REVIEWS)


# Scans -------------------------------------------------------------------------------------------------------------


@query("s01_scan_events", _LISTINGS + "SELECT uuid, title, price, category, venue, city, source, url FROM listings")
def s01(spark, sf):
    return b.listings(spark, sf).select("uuid", "title", "price", "category", "venue", "city", "source", "url")


@query("s02_first_events", _LISTINGS + "SELECT uuid, title, price FROM listings ORDER BY uuid LIMIT 100")
def s02(spark, sf):
    return first_rows(b.listings(spark, sf).select("uuid", "title", "price"), 100, "uuid")


@query("s03_first_summaries", with_sql(b.REVIEWS) + """
SELECT event_uuid, quality_score, importance FROM reviews ORDER BY event_uuid LIMIT 100""")
def s03(spark, sf):
    return first_rows(b.reviews(spark, sf).select("event_uuid", "quality_score", "importance"), 100, "event_uuid")


# Projections, lookups and filters ----------------------------------------------------------------------------------


@query("p02_collapse_nulls", _LISTINGS + """
SELECT uuid, coalesce(title, '') AS title, coalesce(description, '') AS description, price,
       coalesce(venue, '') AS venue, coalesce(category, 'Etkinlik') AS category FROM listings""")
def p02(spark, sf):
    df = b.listings(spark, sf).select("uuid", "title", "description", "price", "venue", "category")
    return normalize.collapse_nulls(df, normalize.EVENT_DEFAULTS)


@query("p03_by_uuid", _LISTINGS + "SELECT uuid, title, price FROM listings WHERE uuid = 4242")
def p03(spark, sf):
    return filters.lookup(b.listings(spark, sf), uuid=4242).select("uuid", "title", "price")


@query("p04_by_category_and_venue", _LISTINGS + """
SELECT uuid, title, price FROM listings WHERE category = '1-URGENT' AND venue = 'NATION_7' AND source = 'F'""")
def p04(spark, sf):
    found = filters.lookup(b.listings(spark, sf), category="1-URGENT", venue="NATION_7", source="F")
    return found.select("uuid", "title", "price")


@query("p04_by_title_venue_date", _LISTINGS + """
SELECT uuid, title, venue FROM listings WHERE title = 'Customer#000000007' AND venue IS NOT NULL
AND date >= TIMESTAMP '1995-01-01'""")
def p04_title(spark, sf):
    found = filters.lookup(b.listings(spark, sf), title="Customer#000000007")
    found = found.filter(F.col("venue").isNotNull() & (F.col("date") >= F.lit("1995-01-01").cast("timestamp")))
    return found.select("uuid", "title", "venue")


@query("p05_by_content_type", with_sql(b.RATINGS) + """
SELECT event_uuid, rating, rating_count FROM ratings WHERE content_type = 'user_review'""")
def p05(spark, sf):
    return filters.lookup(b.ratings(spark, sf), content_type="user_review").select("event_uuid", "rating", "rating_count")


@query("p05_by_person_name", "SELECT s_suppkey AS uuid, s_name AS name FROM supplier WHERE s_name = 'Supplier#000000003'")
def p05_person(spark, sf):
    return filters.lookup(b.people(spark, sf), name="Supplier#000000003")


SEARCH = SearchFilters(max_price=1500, city="build", category="high", start="1996-01-01", end="1999-12-31")


@query("p06_search_filter", _LISTINGS + """
SELECT uuid, price FROM listings WHERE price <= 1500 AND contains(lower(city), 'build')
AND contains(lower(category), 'high') AND date >= '1996-01-01' AND date <= '1999-12-31'""")
def p06(spark, sf):
    return filters.search_filter(b.listings(spark, sf), SEARCH, relax=False).select("uuid", "price")


@query("p07_relaxed_filter", _LISTINGS + "SELECT uuid, price FROM listings")
def p07(spark, sf):
    # No city contains this text, so the filter falls away.
    return filters.search_filter(b.listings(spark, sf), SearchFilters(city="atlantis")).select("uuid", "price")


@query("p07_kept_filter", _LISTINGS + "SELECT uuid, price FROM listings WHERE contains(lower(city), 'machin')")
def p07_kept(spark, sf):
    return filters.search_filter(b.listings(spark, sf), SearchFilters(city="MACHIN")).select("uuid", "price")


@query("p08_validate_items", """
SELECT o_orderkey AS uuid, CASE WHEN o_totalprice BETWEEN 0 AND 100000 THEN o_totalprice END AS price,
       CASE WHEN o_orderstatus = 'P' THEN 'orders' ELSE o_orderstatus END AS source,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Missing title' END AS reject_reason FROM orders""")
def p08(spark, sf):
    items = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("uuid"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("title"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("source"),
    )
    return normalize.validate_items(items, "orders").select("uuid", "price", "source", "reject_reason")


@query("p09_price_worklist", _LISTINGS + "SELECT url, title, uuid FROM listings WHERE source = 'P' AND price IS NULL")
def p09(spark, sf):
    return filters.price_worklist(b.listings(spark, sf), "P")


@query("p13_quality_gate", _ARTICLE_REVIEWS + """
SELECT event_uuid, quality_score FROM reviews WHERE quality_score IS NULL OR quality_score = 0 OR quality_score >= 3""")
def p13(spark, sf):
    return filters.quality_gate(b.reviews(spark, sf)).select("event_uuid", "quality_score")


@query("p14_enrichable", with_sql(b.LISTINGS, b.RATINGS, b.CREW) + """
SELECT uuid, length(trim(coalesce(description, ''))) > 10
   OR uuid IN (SELECT event_uuid FROM ratings WHERE content_type = 'user_review')
   OR uuid IN (SELECT event_uuid FROM crew WHERE role = 'WROTE') AS eligible FROM listings""")
def p14(spark, sf):
    reviews = filters.lookup(b.ratings(spark, sf), content_type="user_review")
    writers = filters.lookup(b.crew(spark, sf), role="WROTE")
    return filters.mark_enrichable(b.listings(spark, sf), reviews, writers).select("uuid", "eligible")


@query("p15_extractable", _LISTINGS + "SELECT uuid FROM listings WHERE length(description) >= 20")
def p15(spark, sf):
    return filters.extractable(b.listings(spark, sf)).select("uuid")


@query("p16_boilerplate", """
SELECT doc_id, regexp_matches(lower(text), 'no reviews available|impossible to gauge|no description') AS poor
FROM documents""")
def p16(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", text.is_boilerplate(F.col("text")).alias("poor"))


# Joins -------------------------------------------------------------------------------------------------------------


@query("j01_with_summary", _ARTICLE_REVIEWS + """
SELECT uuid, title, price, quality_score FROM articles JOIN reviews ON uuid = event_uuid
WHERE price > 0 AND quality_score >= 5""")
def j01(spark, sf):
    joined = relations.with_summary(b.articles(spark, sf), b.reviews(spark, sf))
    return joined.filter("price > 0 AND quality_score >= 5").select("uuid", "title", "price", "quality_score")


@query("j02_with_rating", with_sql(b.LISTINGS, b.RATINGS) + """
, r AS (SELECT event_uuid, max(rating) AS rating, max(rating_count) AS rating_count FROM ratings
        WHERE content_type = 'platform_rating' GROUP BY event_uuid)
SELECT uuid, title, rating, rating_count FROM listings LEFT JOIN r ON uuid = event_uuid
ORDER BY date DESC, uuid LIMIT 10""")
def j02(spark, sf):
    rated = b.ratings(spark, sf).groupBy("event_uuid", "content_type").agg(
        F.max("rating").alias("rating"), F.max("rating_count").alias("rating_count")
    )
    joined = relations.with_rating(b.listings(spark, sf), rated)
    return rollups.top_k(joined, 10, F.desc("date"), F.asc("uuid")).select("uuid", "title", "rating", "rating_count")


_MEMBERS = """
, members AS (SELECT category, uuid AS event_uuid, row_number() OVER (PARTITION BY category ORDER BY price DESC, uuid) AS rank
              FROM articles QUALIFY rank <= 10)
"""


def members(spark, sf):
    """Ten dearest articles per category as a stored collection."""
    best = rollups.top_k(b.articles(spark, sf), 10, F.desc("price"), F.asc("uuid"), by="category")
    return best.select("category", F.col("uuid").alias("event_uuid"), "rank", F.lit("long read").alias("reason"))


@query("j03_collection_view", _ARTICLE_REVIEWS + _MEMBERS + """
SELECT title, venue, price, 'long read' AS reason, rank, sentiment_summary AS summary
FROM members m JOIN articles ON uuid = m.event_uuid LEFT JOIN reviews r ON r.event_uuid = uuid
WHERE m.category = 'en' ORDER BY rank LIMIT 5""")
def j03(spark, sf):
    events = b.articles(spark, sf).withColumn("date", F.lit(None).cast("timestamp"))
    return relations.collection_view(members(spark, sf), events, b.reviews(spark, sf), "en").drop("date")


@query("j04_with_content", with_sql(b.LISTINGS, b.RATINGS) + """
SELECT uuid, title, rating FROM listings JOIN ratings ON uuid = event_uuid WHERE content_type = 'ai_summary'""")
def j04(spark, sf):
    return relations.with_content(b.listings(spark, sf), b.ratings(spark, sf), "ai_summary").select("uuid", "title", "rating")


@query("j05_with_people", with_sql(b.LISTINGS, b.CREW) + """
SELECT uuid, s_name AS name, role FROM listings JOIN crew ON uuid = event_uuid JOIN supplier ON s_suppkey = person_uuid""")
def j05(spark, sf):
    joined = relations.with_people(b.listings(spark, sf), b.people(spark, sf), b.crew(spark, sf))
    return joined.select("uuid", "name", "role")


@query("j07_backlog", _ARTICLE_REVIEWS + "SELECT uuid, title FROM articles ANTI JOIN reviews ON uuid = event_uuid")
def j07(spark, sf):
    return relations.backlog(b.articles(spark, sf), b.reviews(spark, sf)).select("uuid", "title")


@query("j08_metadata_coverage", _ARTICLE_REVIEWS + """
SELECT count(*) AS total, count(*) FILTER (category IS NOT NULL OR venue IS NOT NULL) AS not_null,
       count(*) FILTER (coalesce(category, '') <> '' OR coalesce(venue, '') <> '') AS non_empty
FROM articles JOIN reviews ON uuid = event_uuid""")
def j08(spark, sf):
    return relations.metadata_coverage(b.articles(spark, sf), b.reviews(spark, sf), ("category", "venue"))


@query("j12_new_items", _LISTINGS + """
, stored AS (SELECT trim(title) AS t, trim(coalesce(venue, '')) AS v, date AS d FROM listings WHERE source = 'F')
SELECT uuid FROM listings WHERE source <> 'F' AND NOT EXISTS (
  SELECT 1 FROM stored WHERE t = trim(title) AND v = trim(coalesce(venue, '')) AND d = date)""")
def j12(spark, sf):
    df = b.listings(spark, sf)
    return relations.new_items(df.filter("source <> 'F'"), df.filter("source = 'F'")).select("uuid")


@query("j14_summary_of_event", _ARTICLE_REVIEWS + """
SELECT uuid, quality_score, importance FROM articles LEFT JOIN reviews ON uuid = event_uuid""")
def j14(spark, sf):
    one = relations.one_per(b.reviews(spark, sf), "event_uuid", F.desc("updated_at"))
    return relations.with_summary(b.articles(spark, sf), one, "left").select("uuid", "quality_score", "importance")


@query("j15_venue_attributes", _LISTINGS + """
SELECT uuid, venue, r_name AS vibe FROM listings LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey)
ON n_name = venue""")
def j15(spark, sf):
    nations, regions = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    venues = nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.col("n_name").alias("name"), F.lit(False).alias("is_outdoors"), F.lit(0).alias("capacity"),
        F.col("r_name").alias("vibe"),
    )
    return relations.with_venue_attributes(b.listings(spark, sf), venues).select("uuid", "venue", "vibe")


@query("j16_members_only", _ARTICLE_REVIEWS + _MEMBERS + "SELECT uuid, title FROM articles SEMI JOIN members ON uuid = event_uuid")
def j16(spark, sf):
    ids = members(spark, sf).select(F.col("event_uuid").alias("uuid"))
    return relations.restrict_to(b.articles(spark, sf), ids).select("uuid", "title")


@query("j17_edge_counts", with_sql(b.RATINGS, b.CREW) + """
SELECT 'has_content' AS type, count(*) AS n FROM ratings
UNION ALL SELECT 'works_on', count(*) FROM crew UNION ALL SELECT 'has_summary', count(*) FROM labels""")
def j17(spark, sf):
    return relations.edge_counts(
        has_content=b.ratings(spark, sf), works_on=b.crew(spark, sf), has_summary=read_table(spark, sf, "labels")
    )


# Grouped lookups ---------------------------------------------------------------------------------------------------


@query("a23_average_rating", with_sql(b.RATINGS) + """
SELECT event_uuid, round(avg(rating) FILTER (rating > 0), 6) AS avg_rating FROM ratings
WHERE content_type = 'user_review' GROUP BY event_uuid""")
def a23(spark, sf):
    return rounded(relations.average_rating(b.ratings(spark, sf)), avg_rating=6)


@query("a24_top_rated", with_sql(b.RATINGS) + """
SELECT event_uuid, round(avg(rating), 6) AS avg_rating, count(*) AS review_count FROM ratings
WHERE content_type = 'user_review' AND rating > 0 GROUP BY event_uuid HAVING count(*) >= 3
ORDER BY avg(rating) DESC, event_uuid LIMIT 10""")
def a24(spark, sf):
    return rounded(relations.top_rated(b.ratings(spark, sf)), avg_rating=6)


@query("a25_counts_by_source", _LISTINGS + "SELECT source, count(*) AS n FROM listings GROUP BY source")
def a25(spark, sf):
    return relations.counts_by(b.listings(spark, sf), "source")


@query("a26_summary_audit", with_sql(b.REVIEWS) + """
SELECT count(*) AS total, round(avg(quality_score), 6) AS avg_score, min(quality_score) AS min_score,
       max(quality_score) AS max_score,
       count(*) FILTER (regexp_matches(lower(sentiment_summary), 'no reviews available|impossible to gauge|no description'))
         AS n_boilerplate,
       round(count(*) FILTER (regexp_matches(lower(sentiment_summary),
             'no reviews available|impossible to gauge|no description')) * 100.0 / count(*), 4) AS pct_boilerplate
FROM reviews""")
def a26(spark, sf):
    return rounded(enrich.summary_audit(b.reviews(spark, sf)), avg_score=6, pct_boilerplate=4)


@query("a26_rating_distribution", with_sql(b.REVIEWS) + """
SELECT 'importance' AS field, coalesce(importance, 'Unknown') AS value, count(*) AS n FROM reviews GROUP BY ALL
UNION ALL SELECT 'value_rating', coalesce(value_rating, 'Unknown'), count(*) FROM reviews GROUP BY ALL""")
def a26_ratings(spark, sf):
    return enrich.rating_distribution(b.reviews(spark, sf))


@query("a26_priced_share", _ARTICLE_REVIEWS + """
SELECT count(*) AS total, count(*) FILTER (length(venue) > 4) AS n_priced,
       round(count(*) FILTER (length(venue) > 4) * 100.0 / count(*), 4) AS pct_priced
FROM articles JOIN reviews ON uuid = event_uuid""")
def a26_priced(spark, sf):
    events = b.articles(spark, sf).withColumn("category_prices", F.concat("venue", F.lit("+")))
    return rounded(enrich.priced_share(events, b.reviews(spark, sf)), pct_priced=4)


@query("a27_backlog_report", _ARTICLE_REVIEWS + """
, m AS (SELECT length(trim(description)) > 10 AS ready, event_uuid IS NULL AS open
        FROM articles LEFT JOIN reviews ON uuid = event_uuid),
t AS (SELECT count(*) AS total, count(*) FILTER (open) AS pending, count(*) FILTER (open AND ready) AS actionable,
             count(*) FILTER (open AND NOT ready) AS likely_skipped FROM m)
SELECT *, round((total - pending) * 100.0 / total, 4) AS progress,
       round(CASE WHEN actionable > 0 THEN actionable ELSE likely_skipped END * 0.2 / 60, 4) AS cloud_minutes,
       round(CASE WHEN actionable > 0 THEN actionable ELSE likely_skipped END * 1.5 / 60, 4) AS local_minutes FROM t""")
def a27(spark, sf):
    report = enrich.backlog_report(b.articles(spark, sf), b.reviews(spark, sf))
    report = report.withColumns({c: F.col(c).cast("double") for c in ("progress", "cloud_minutes", "local_minutes")})
    return rounded(report, progress=4, cloud_minutes=4, local_minutes=4)


@query("a28_exact_duplicates", """
SELECT text, lang, count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1""")
def a28(spark, sf):
    return relations.exact_duplicates(read_table(spark, sf, "documents"), ("text", "lang")).select("text", "lang", "n")


@query("a31_people_by_role", with_sql(b.CREW) + """
, u AS (SELECT DISTINCT event_uuid, role, s_name FROM crew JOIN supplier ON s_suppkey = person_uuid),
r AS (SELECT event_uuid, role || ': ' || string_agg(s_name, ', ' ORDER BY s_name) AS line FROM u GROUP BY event_uuid, role)
SELECT event_uuid, string_agg(line, chr(10) ORDER BY line) AS people FROM r GROUP BY event_uuid""")
def a31(spark, sf):
    edges = b.crew(spark, sf).join(b.people(spark, sf).withColumnRenamed("uuid", "person_uuid"), "person_uuid")
    return enrich.people_text(edges)


@query("t06_review_text", """
WITH r AS (
  SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS t FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5)
SELECT conv_id AS event_uuid, string_agg('- ' || t, chr(10) ORDER BY turn) AS reviews FROM r GROUP BY conv_id""")
def t06(spark, sf):
    content = read_table(spark, sf, "conversations").withColumnRenamed("conv_id", "event_uuid")
    return enrich.review_text(content, "turn")


@query("t07_latest_per_source", _LISTINGS + """
SELECT uuid, source, row_number() OVER (PARTITION BY source ORDER BY date DESC, uuid) AS rank FROM listings
QUALIFY rank <= 10""")
def t07(spark, sf):
    return relations.latest_per(b.listings(spark, sf), "source", "date", 10, "uuid").select("uuid", "source", "rank")


@query("u03_distinct_venues", _LISTINGS + "SELECT DISTINCT venue FROM listings WHERE venue <> ''")
def u03(spark, sf):
    return relations.distinct_venues(b.listings(spark, sf))


@query("u04_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u04(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id").subtract(read_table(spark, sf, "labels").select("doc_id"))


@query("u05_intersection", "SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def u05(spark, sf):
    ids = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return read_table(spark, sf, "labels").select("doc_id").intersect(ids)


@query("u06_two_sources", _LISTINGS + """
SELECT * FROM (SELECT uuid, source FROM listings WHERE source = 'F' ORDER BY date DESC, uuid LIMIT 10)
UNION ALL SELECT * FROM (SELECT uuid, source FROM listings WHERE source = 'O' ORDER BY date DESC, uuid LIMIT 10)""")
def u06(spark, sf):
    df = b.listings(spark, sf)
    parts = [rollups.top_k(filters.lookup(df, source=s), 10, F.desc("date"), F.asc("uuid")) for s in ("F", "O")]
    return parts[0].unionByName(parts[1]).select("uuid", "source")


# Write-side operators ----------------------------------------------------------------------------------------------

# The stored table is the finished orders; the updates are all orders, so known keys change and new ones appear.


def _stored(spark, sf):
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("uuid"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.col("o_orderstatus").alias("source"),
    )


@query("s05_upsert", """
SELECT o_orderkey AS uuid, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 2 END AS price,
       o_orderpriority AS category, o_orderstatus AS source FROM orders""")
def s05(spark, sf):
    df = _stored(spark, sf)
    older = df.withColumn("price", F.lit(0.0)).withColumn("updated_at", F.lit("1990-01-01").cast("timestamp"))
    changed = df.filter("source <> 'F'").withColumn("price", F.col("price") * 2)
    updates = changed.unionByName(older.filter("source <> 'F'"))
    return sinks.upsert(df.filter("source <> 'O'"), updates).select("uuid", "price", "category", "source")


@query("s06_patch", """
SELECT o_orderkey AS uuid, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN o_totalprice + 1 ELSE o_totalprice END
         AS price, o_orderpriority AS category FROM orders""")
def s06(spark, sf):
    df = _stored(spark, sf)
    updates = df.filter("source <> 'O'").select("uuid", F.when(F.col("source") == "F", F.col("price") + 1).alias("price"), "updated_at")
    older = updates.withColumns({"price": F.lit(0.0), "updated_at": F.lit("1990-01-01").cast("timestamp")})
    return sinks.patch(df, updates.unionByName(older), ["price"]).select("uuid", "price", "category")


@query("s07_child_upsert", """
SELECT l_orderkey * 10 + l_linenumber AS uuid, l_orderkey AS event_uuid,
       CASE WHEN o_orderstatus = 'F' THEN max(l_quantity) ELSE -1 END AS rating
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F' OR l_linenumber = 1 GROUP BY 1, 2, o_orderstatus""")
def s07(spark, sf):
    content = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"), F.col("l_orderkey").alias("event_uuid"),
        F.col("l_quantity").alias("rating"), F.col("l_shipdate").alias("updated_at"),
    )
    content = content.groupBy("uuid", "event_uuid").agg(
        F.max("rating").alias("rating"), F.max("updated_at").alias("updated_at")
    )
    parents = _stored(spark, sf).filter("source = 'F'")
    # stored: an old rating of every first line; lines of unfinished orders have no parent and keep it
    stored = content.where("uuid % 10 = 1").withColumns({"rating": F.lit(-1.0), "updated_at": F.lit("1990-01-01").cast("timestamp_ntz")})
    return sinks.upsert_children(stored, content, parents).select("uuid", "event_uuid", "rating")


@query("s08_summary_edges", _ARTICLE_REVIEWS + """
SELECT event_uuid FROM reviews WHERE event_uuid IN (SELECT uuid FROM articles WHERE category = 'en')""")
def s08(spark, sf):
    summaries = b.reviews(spark, sf)
    events = b.articles(spark, sf).filter("category = 'en'")
    # two thirds are stored already, two thirds arrive
    stored, new = (summaries.where(F.pmod(F.xxhash64("event_uuid"), F.lit(3)) != k) for k in (0, 1))
    return sinks.upsert_summaries(stored, new, events)[1]


@query("s09_overlay", """
SELECT n_name AS category, CASE WHEN n_regionkey = 1 THEN 'renamed' ELSE n_name END AS name, n_regionkey AS region FROM nation""")
def s09(spark, sf):
    nations = read_table(spark, sf, "nation")
    target = nations.select(F.col("n_name").alias("category"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    updates = nations.select(F.col("n_name").alias("category"), F.when(F.col("n_regionkey") == 1, "renamed").alias("name"))
    return sinks.overlay(target, updates)


@query("s10_replace_members", _ARTICLE_REVIEWS + _MEMBERS + """
SELECT category, event_uuid, CAST(rank AS INT) AS rank FROM members WHERE category <> 'en'
UNION ALL SELECT category, uuid, 1 FROM (SELECT * FROM articles WHERE category = 'en' ORDER BY price, uuid LIMIT 1)""")
def s10(spark, sf):
    stored = members(spark, sf).select("category", "event_uuid", "rank")
    cheapest = rollups.top_k(filters.lookup(b.articles(spark, sf), category="en"), 1, F.asc("price"), F.asc("uuid"))
    return sinks.replace_members(stored, cheapest.select("category", F.col("uuid").alias("event_uuid"), F.lit(1).alias("rank")))


@query("s11_delete_keys", "SELECT o_orderkey AS uuid FROM orders WHERE o_orderstatus <> 'P'")
def s11(spark, sf):
    df = _stored(spark, sf)
    return sinks.delete_keys(df, df.filter("source = 'P'")).select("uuid")


@query("s11_detach_edges", with_sql(b.CREW) + """
SELECT person_uuid, event_uuid, role FROM crew WHERE event_uuid NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def s11_edges(spark, sf):
    return sinks.detach(b.crew(spark, sf), _stored(spark, sf).filter("source = 'P'"), "event_uuid")


@query("s12_find_or_create", """
SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer""")
def s12(spark, sf):
    names = read_table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return sinks.find_or_create(b.people(spark, sf), names).select("name")


@query("s13_edge_upsert", with_sql(b.CREW) + """
SELECT DISTINCT person_uuid, event_uuid, role FROM crew JOIN supplier ON s_suppkey = person_uuid
JOIN orders ON o_orderkey = event_uuid WHERE role IN ('WROTE', 'DIRECTED', 'ACTED_IN', 'PERFORMED_BY', 'COMPOSED',
'CONDUCTED', 'CREW')""")
def s13(spark, sf):
    edges = b.crew(spark, sf)
    people, events = b.people(spark, sf), _stored(spark, sf)
    stored = sinks.upsert_edges(edges.limit(0), edges.where("event_uuid % 2 = 0"), people, events)
    return sinks.upsert_edges(stored, edges, people, events)


@query("s13_rejected_edges", with_sql(b.CREW) + """
SELECT role, count(*) AS n FROM crew WHERE role NOT IN ('WROTE', 'DIRECTED', 'ACTED_IN', 'PERFORMED_BY', 'COMPOSED',
'CONDUCTED', 'CREW') GROUP BY role""")
def s13_rejected(spark, sf):
    bad = sinks.check_roles(b.crew(spark, sf)).filter(F.col("reject_reason").isNotNull())
    return relations.counts_by(bad, "role")


@query("s14_same_as", """
SELECT least(o_orderkey, o_custkey) AS uuid_a, greatest(o_orderkey, o_custkey) AS uuid_b,
       coalesce(max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 0.5) AS score,
       CASE WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN '2026-01-01' ELSE '2025-01-01' END AS day
FROM orders GROUP BY 1, 2""")
def s14(spark, sf):
    """Stored pairs (customer, order) get the scores of the links that arrive in the other direction."""
    orders = read_table(spark, sf, "orders")
    pairs = orders.select(F.col("o_custkey").alias("uuid_a"), F.col("o_orderkey").alias("uuid_b"), F.lit(0.5).alias("score"), "o_orderstatus")
    none = pairs.select("uuid_a", "uuid_b", "score", F.lit(None).cast("timestamp").alias("updated_at")).limit(0)
    stored = sinks.upsert_same_as(none, pairs.where("o_orderstatus <> 'O'"), F.lit("2025-01-01").cast("timestamp"))
    links = orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("uuid_a"), F.col("o_custkey").alias("uuid_b"), F.col("o_totalprice").alias("score")
    )
    out = sinks.upsert_same_as(stored, links, F.lit("2026-01-01").cast("timestamp"))
    return out.select("uuid_a", "uuid_b", "score", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query("s15_report", """
SELECT count(*) AS dataset_size, round(avg(o_totalprice), 2) AS mean, count(*) FILTER (o_orderstatus = 'P') AS anomalies FROM orders""")
def s15(spark, sf):
    """The report document, written and read back."""
    folder = scratch_folder(spark, "report")
    orders = read_table(spark, sf, "orders")
    size = orders.agg(F.count("*").alias("n")).scalar()
    sinks.write_report(
        folder, F.lit("2026-01-01"), size, orders.agg(F.round(F.avg("o_totalprice"), 2).alias("mean")),
        orders.agg(F.count_if(F.col("o_orderstatus") == "P").alias("anomalies")),
    )
    schema = "metadata struct<dataset_size: bigint>, statistical_analysis struct<mean: double>, anomaly_detection struct<anomalies: bigint>"
    return spark.read.schema(schema).json(folder).select("metadata.dataset_size", "statistical_analysis.mean", "anomaly_detection.anomalies")


@query("s16_embeddings", """
SELECT vec_id AS event_uuid, CASE WHEN label < 5 THEN embedding[1]::DOUBLE END AS first,
       CASE WHEN label < 5 THEN '2026-01-01' END AS day FROM embeddings""")
def s16(spark, sf):
    """Summaries whose new vectors arrive twice, the older one with zeros."""
    vectors = read_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "event_uuid")
    stored = vectors.select("event_uuid", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("timestamp").alias("updated_at"))
    fresh = vectors.where("label < 5").select("event_uuid", "embedding")
    zeros = fresh.select("event_uuid", F.transform("embedding", lambda x: F.lit(-9.0).cast("float")).alias("embedding"))
    out = sinks.set_embeddings(stored, fresh.unionByName(zeros), F.lit("2026-01-01").cast("timestamp"))
    return out.select("event_uuid", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


# The same writes on tables in buckets: only the buckets of the changed keys are read and written.


def _bucketed(spark, name, rows, key="uuid", n=32):
    """A new table of ``rows``."""
    path = f"{scratch_folder(spark, name)}/table"
    buckets.create(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), key, n, rows)
    return path


@query("s05_bucketed_writes", """
SELECT o_orderkey AS uuid, o_orderstatus AS source, o_orderpriority AS category,
       CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL
            WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice * 2 END AS price
FROM orders WHERE o_orderpriority <> '5-LOW'""")
def s05_bucketed(spark, sf):
    """An upsert, a price update and a delete, one after the other."""
    df = _stored(spark, sf)
    path = _bucketed(spark, "upsert", df.where("source <> 'O'"))
    older = df.withColumns({"price": F.lit(0.0), "updated_at": F.lit("1990-01-01").cast("timestamp")})
    updates = df.withColumn("price", F.col("price") * 2).unionByName(older).where("source <> 'F'")
    buckets.upsert(spark, path, updates)
    indebted = read_table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    unpriced = read_table(spark, sf, "orders").join(indebted, "o_custkey", "left_semi").select(
        F.col("o_orderkey").alias("uuid"), F.lit(None).cast("double").alias("price")
    )
    buckets.patch(spark, path, unpriced, ["price"])
    buckets.delete(spark, path, df.where("category = '5-LOW'").select("uuid"))
    return buckets.read(spark, path).select("uuid", "source", "category", "price")


@query("s07_bucketed_children", """
SELECT l_orderkey * 10 + l_linenumber AS uuid, l_orderkey AS event_uuid, max(l_quantity) AS rating
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def s07_bucketed(spark, sf):
    """Children are written where their parent is stored."""
    parents = _bucketed(spark, "parents", _stored(spark, sf).where("source = 'F'"))
    content = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"), F.col("l_orderkey").alias("event_uuid"),
        F.col("l_quantity").alias("rating"),
    ).groupBy("uuid", "event_uuid").agg(F.max("rating").alias("rating")).withColumn("updated_at", F.lit(1))
    path = _bucketed(spark, "children", content.limit(0))
    buckets.upsert_children(spark, path, content, parents)
    return buckets.read(spark, path).select("uuid", "event_uuid", "rating")


@query("s09_bucketed_overlay", """
SELECT c_custkey AS category, CASE WHEN c_acctbal < 0 THEN 'in debt' WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS name,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS region
FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal < 0""")
def s09_bucketed(spark, sf):
    """Names of customers in debt change; those not stored yet are new rows without a region."""
    customers = read_table(spark, sf, "customer").withColumn("category", F.col("c_custkey"))
    stored = customers.where("c_mktsegment <> 'BUILDING'").select(
        "category", F.col("c_name").alias("name"), F.col("c_nationkey").alias("region"), F.lit(0).alias("updated_at")
    )
    path = _bucketed(spark, "overlay", stored, "category")
    changed = customers.where("c_acctbal < 0").select("category", F.lit("in debt").alias("name"), F.lit(1).alias("updated_at"))
    buckets.overlay(spark, path, changed)
    return buckets.read(spark, path).select("category", "name", "region")


@query("p03_bucketed_lookup", "SELECT o_orderkey AS uuid, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT'")
def p03_bucketed(spark, sf):
    """Rows of given keys; buckets without any of them are not read."""
    df = _stored(spark, sf)
    path = _bucketed(spark, "lookup", df)
    return buckets.lookup(spark, path, df.where("category = '1-URGENT'").select("uuid")).select("uuid", "price")
