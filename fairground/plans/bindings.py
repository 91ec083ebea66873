"""The supplied tables seen as event catalogues, in Spark and (for checking) in SQL.

Both sides are derived from the same columns by the same rules; missing values are derived from real attributes:
pending orders are unpriced, customers in debt have no venue, low-priority orders have no description.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairground.operators.normalize import normalize_events
from fairground.sources.tables import read_table


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events: priced per priority (category), nation (venue) and market segment (city)."""
    orders = read_table(spark, sf, "orders")
    customers = read_table(spark, sf, "customer")
    nations = read_table(spark, sf, "nation")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, customers.c_nationkey == nations.n_nationkey
    )
    described = F.concat(F.lit("Order of "), "c_name", F.lit(" in "), "n_name", F.lit(" for "), "c_mktsegment")
    return joined.select(
        F.col("o_orderkey").alias("uuid"),
        F.col("c_name").alias("title"),
        F.when(F.col("o_orderpriority") != "5-LOW", described).alias("description"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 200).alias("price"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("venue"),
        F.col("c_mktsegment").alias("city"),
        F.col("o_orderstatus").alias("source"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.concat(F.lit("https://listings.example/"), F.col("o_orderkey").cast("string")).alias("url"),
    )


LISTINGS = """listings AS (
  SELECT o_orderkey AS uuid, c_name AS title,
         CASE WHEN o_orderpriority <> '5-LOW'
              THEN 'Order of ' || c_name || ' in ' || n_name || ' for ' || c_mktsegment END AS description,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 200 END AS price,
         o_orderpriority AS category, CASE WHEN c_acctbal >= 0 THEN n_name END AS venue,
         c_mktsegment AS city, o_orderstatus AS source, o_orderdate AS date,
         'https://listings.example/' || o_orderkey AS url
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def activity(spark: SparkSession, sf: str) -> DataFrame:
    """The events stream as a catalogue: priced by value, one venue per user, real times of day."""
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("uuid"),
        F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string")).alias("title"),
        F.col("props").alias("description"),
        F.col("value").alias("price"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("venue"),
        F.col("ts").cast("timestamp").alias("date"),
    )


ACTIVITY = """activity AS (
  SELECT event_id AS uuid, event_type || ' of user ' || user_id AS title, props AS description, value AS price,
         event_type AS category, 'user ' || user_id AS venue, ts AS date FROM events)"""


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as events: the largest price table."""
    return read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        F.col("l_linestatus").alias("description"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("category"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("venue"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
    )


SHIPMENTS = """shipments AS (
  SELECT l_orderkey * 10 + l_linenumber AS uuid, 'Part ' || l_partkey AS title, l_linestatus AS description,
         l_extendedprice AS price, l_returnflag AS category, 'supplier ' || l_suppkey AS venue, l_shipdate AS date
  FROM lineitem)"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as events: language is the category, source the venue, length the price."""
    return read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("uuid"),
        F.concat("lang", F.lit(" from "), "source").alias("title"),
        F.col("text").alias("description"),
        F.col("n_chars").cast("double").alias("price"),
        F.col("lang").alias("category"),
        F.col("source").alias("venue"),
    )


ARTICLES = """articles AS (
  SELECT doc_id AS uuid, lang || ' from ' || source AS title, text AS description,
         CAST(n_chars AS DOUBLE) AS price, lang AS category, source AS venue FROM documents)"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Labels joined to their documents as event summaries. Score: 2, +5 for quality, +2 for long, +1 non-toxic."""
    labels, documents = read_table(spark, sf, "labels"), read_table(spark, sf, "documents")
    joined = labels.join(documents, "doc_id")
    score = (
        F.lit(2.0) + F.col("quality") * 5 + F.when(F.col("n_chars") > 2000, 2).otherwise(0)
        + F.when(F.col("toxic") == 0, 1).otherwise(0)
    )
    return joined.select(
        F.col("doc_id").alias("event_uuid"),
        score.cast("double").alias("quality_score"),
        F.when(F.col("quality") == 1, "popular").otherwise("niche").alias("importance"),
        F.when(F.col("toxic") == 1, "expensive").when(F.col("n_chars") > 2000, "good").alias("value_rating"),
        F.col("text").alias("sentiment_summary"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("updated_at"),
    )


REVIEWS = """reviews AS (
  SELECT doc_id AS event_uuid,
         CAST(2 + quality * 5 + CASE WHEN n_chars > 2000 THEN 2 ELSE 0 END
              + CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS DOUBLE) AS quality_score,
         CASE WHEN quality = 1 THEN 'popular' ELSE 'niche' END AS importance,
         CASE WHEN toxic = 1 THEN 'expensive' WHEN n_chars > 2000 THEN 'good' END AS value_rating,
         text AS sentiment_summary, 1700000000 + doc_id * 60 AS updated_at
  FROM labels JOIN documents USING (doc_id))"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as reviews of their order: quantity is the rating, the return flag the kind of content."""
    return read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("event_uuid"),
        F.when(F.col("l_returnflag") == "N", "user_review").when(F.col("l_returnflag") == "R", "platform_rating")
        .otherwise("ai_summary").alias("content_type"),
        F.col("l_quantity").alias("rating"),
        F.col("l_linenumber").alias("rating_count"),
    )


RATINGS = """ratings AS (
  SELECT l_orderkey AS event_uuid,
         CASE l_returnflag WHEN 'N' THEN 'user_review' WHEN 'R' THEN 'platform_rating' ELSE 'ai_summary' END
           AS content_type,
         l_quantity AS rating, l_linenumber AS rating_count FROM lineitem)"""


def crew(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of an order as people working on an event; line status and flag decide the role."""
    role = F.concat_ws("_", "l_returnflag", "l_linestatus")
    names = {"N_O": "WROTE", "N_F": "DIRECTED", "R_F": "ACTED_IN", "R_O": "COMPOSED", "A_F": "CREW"}
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("person_uuid"),
        F.col("l_orderkey").alias("event_uuid"),
        F.coalesce(F.create_map(*pairs)[role], F.lit("TRANSLATED")).alias("role"),
    )


CREW = """crew AS (
  SELECT l_suppkey AS person_uuid, l_orderkey AS event_uuid,
         CASE l_returnflag || '_' || l_linestatus WHEN 'N_O' THEN 'WROTE' WHEN 'N_F' THEN 'DIRECTED'
           WHEN 'R_F' THEN 'ACTED_IN' WHEN 'R_O' THEN 'COMPOSED' WHEN 'A_F' THEN 'CREW' ELSE 'TRANSLATED' END AS role
  FROM lineitem)"""


def people(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("uuid"), F.col("s_name").alias("name"))


def normalized(name: str) -> str:
    """SQL of the analysis frame over one of the catalogues above."""
    return f"""norm AS (
  SELECT * REPLACE (coalesce(price, 0) AS price, coalesce(nullif(category, ''), 'unknown') AS category,
                    coalesce(nullif(venue, ''), 'unknown') AS venue, coalesce(description, '') AS description),
         coalesce(description, '') <> '' AS has_description, length(coalesce(description, '')) AS description_length,
         month(date) AS month, isodow(date) - 1 AS day_of_week, hour(date) AS hour FROM {name}),
priced AS (SELECT * FROM norm WHERE price > 0)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def normal_listings(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_events(listings(spark, sf))


def normal_activity(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_events(activity(spark, sf))


def normal_shipments(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_events(shipments(spark, sf))


NORMAL_LISTINGS = with_sql(LISTINGS, normalized("listings"))
NORMAL_ACTIVITY = with_sql(ACTIVITY, normalized("activity"))
NORMAL_SHIPMENTS = with_sql(SHIPMENTS, normalized("shipments"))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named double columns, as the SQL side does, so that summation order cannot show."""
    return df.withColumns({n: F.round(F.col(n), d) for n, d in digits.items()})
