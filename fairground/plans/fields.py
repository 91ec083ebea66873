"""Text, price, date and reply functions and page extraction over the supplied tables.

Where the tables hold no such text (ticket JSON, listing markup, Turkish dates), Spark first renders it from their
rows; the SQL side works from the rows directly, so the round trip is checked over the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fairground.functions import dates, places, prices, replies, text
from fairground.operators import enrich
from fairground.plans import bindings as b
from fairground.plans.bindings import with_sql
from fairground.plans.registry import query
from fairground.sources import pages
from fairground.sources.tables import read_table

AS_OF = "2024-06-15"
LATE = "2024-11-20"


def as_of(day: str = AS_OF):
    return F.lit(day).cast("timestamp")


MONTHS_SQL = "['Ocak', 'Şubat', 'Mart', 'Nisan', 'Mayıs', 'Haziran', 'Temmuz', 'Ağustos', 'Eylül', 'Ekim', 'Kasım', 'Aralık']"
_LABEL = "{y} || ' ' || " + MONTHS_SQL + "[month(o_orderdate)] || ' ' || lpad(CAST({d} AS VARCHAR), 2, '0')"


def _orders(spark, sf):
    return read_table(spark, sf, "orders").withColumn("uuid", F.col("o_orderkey"))


def _month(c="o_orderdate"):
    return dates.month_name(F.month(c))


# Text ----------------------------------------------------------------------------------------------------------------


@query("f01_clean_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def f01(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("f10_text_functions", """
SELECT p_partkey AS uuid, lower(p_name) AS low, contains(lower(p_name), 'ring') AS has, starts_with(p_name, 'hot') AS starts,
       length(p_name) AS size, p_name[1:5] AS head FROM part""")
def f10(spark, sf):
    name = F.col("p_name")
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("uuid"), F.lower(name).alias("low"), text.contains_ci(name, "RING").alias("has"),
        F.startswith(name, F.lit("hot")).alias("starts"), F.length(name).alias("size"), F.substring(name, 1, 5).alias("head"),
    )


@query("f10_title_label", """
SELECT event_id, upper(event_type[1]) || event_type[2:] || ' Event' AS label FROM events""")
def f10_label(spark, sf):
    kind = F.concat("event_type", F.lit("_event"))
    return read_table(spark, sf, "events").select("event_id", text.title_label(kind).alias("label"))


_TERMS = {"click": "Jazz", "view": "theatre", "signup": "FUN", "purchase": "StandUp", "error": "Puppetry"}


@query("f11_filter_terms", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'Caz' WHEN 'view' THEN 'Tiyatro' WHEN 'purchase' THEN 'Stand up'
  WHEN 'error' THEN 'Puppetry' END AS genre FROM events""")
def f11(spark, sf):
    term = F.create_map(*[F.lit(x) for pair in _TERMS.items() for x in pair])[F.col("event_type")]
    return read_table(spark, sf, "events").select("event_id", places.filter_term(term).alias("genre"))


@query("f12_embedding_text", with_sql(b.ARTICLES) + """
SELECT uuid, title || '. ' || venue || '. ' || category || '. ' || description AS text FROM articles""")
def f12(spark, sf):
    joined = text.embedding_text(F.col("title"), F.col("venue"), F.col("category"), F.col("description"))
    return b.articles(spark, sf).select("uuid", joined.alias("text"))


# Prices --------------------------------------------------------------------------------------------------------------


@query("f02_parse_price", """
SELECT o_orderkey AS uuid,
       CAST(CASE o_orderstatus WHEN 'P' THEN 0.0 WHEN 'F' THEN o_custkey + 0.5 ELSE o_custkey + 0.0 END AS DOUBLE) AS price
FROM orders""")
def f02(spark, sf):
    key = F.col("o_custkey").cast("string")
    shown = F.when(F.col("o_orderstatus") == "P", "Ücretsiz").when(
        F.col("o_orderstatus") == "F", F.concat(key, F.lit(",50 TL"))).otherwise(F.concat(F.lit("from ₺"), key))
    return _orders(spark, sf).select("uuid", prices.parse_price(shown).alias("price"))


def _turkish(c):
    """1234.5 -> '₺1.234,50'."""
    return F.concat(F.lit("₺"), F.translate(F.format_number(c, 2), ",.", ".,"))


@query("f03_turkish_price", "SELECT o_orderkey AS uuid, o_totalprice AS price FROM orders")
def f03(spark, sf):
    return _orders(spark, sf).select("uuid", prices.parse_price(_turkish(F.col("o_totalprice")), "tr").alias("price"))


@query("f34_price_in_text", """
SELECT o_orderkey AS uuid, CAST(CASE WHEN o_orderstatus = 'F' THEN o_custkey + 0.25 END AS DOUBLE) AS price FROM orders""")
def f34(spark, sf):
    key = F.col("o_custkey").cast("string")
    shown = F.concat(F.lit("2 seats, "), key, F.when(F.col("o_orderstatus") == "F", ",25 TL each").otherwise(" TL each"))
    return _orders(spark, sf).select("uuid", prices.price_in_text(shown).alias("price"))


@query("f31_cinema_price", """
SELECT o_orderkey AS uuid, CASE WHEN o_orderpriority = '5-LOW' OR o_orderstatus = 'P' THEN 250.0 ELSE o_totalprice END AS price
FROM orders""")
def f31(spark, sf):
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "Sinema Gala")
    url = F.when(F.col("o_orderstatus") == "P", "https://site.example/tr/SINEMA/1").otherwise("https://site.example/x")
    return _orders(spark, sf).select("uuid", prices.cinema_price(F.col("o_totalprice"), kind, url).alias("price"))


def _tickets(spark, sf):
    """One ticket JSON per order: a price entry per line item."""
    lines = read_table(spark, sf, "lineitem")
    entry = F.struct(F.col("l_returnflag").alias("name"), _turkish(F.col("l_extendedprice")).alias("price"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("uuid")).agg(F.collect_list(entry).alias("prices"))
    return grouped.select("uuid", F.to_json(F.struct("prices")).alias("tickets"))


@query("f17_ticket_prices", """
SELECT l_orderkey AS uuid, l_returnflag AS name, l_extendedprice AS price FROM lineitem""")
def f17(spark, sf):
    return _tickets(spark, sf).select("uuid", F.inline(prices.ticket_prices(F.col("tickets"))))


@query("a33_min_ticket_price", "SELECT l_orderkey AS uuid, min(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey")
def a33(spark, sf):
    return _tickets(spark, sf).select("uuid", prices.min_ticket_price(F.col("tickets")).alias("price"))


# Dates ---------------------------------------------------------------------------------------------------------------


@query("f04_expand_dates", f"""
SELECT o_orderkey AS uuid, {_LABEL.format(y="'2024'", d="d")} AS date FROM orders,
LATERAL (SELECT unnest(range(day(o_orderdate), day(o_orderdate) + 1 + o_custkey % 3)) AS d)""")
def f04(spark, sf):
    day = F.dayofmonth("o_orderdate")
    shown = F.format_string("%s - %02d - %02d", _month(), day, (day + F.col("o_custkey") % 3).cast("int"))
    return _orders(spark, sf).select("uuid", F.explode(dates.expand_dates(shown, as_of())).alias("date"))


@query("f04_day_first_dates", f"""
SELECT o_orderkey AS uuid, {_LABEL.format(y="CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) ELSE 2024 END", d="day(o_orderdate)")}
  AS date FROM orders""")
def f04_day_first(spark, sf):
    shown = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), _month(), F.year("o_orderdate").cast("string"))
    days = dates.expand_dates(shown, as_of(), strict=True)
    return _orders(spark, sf).select("uuid", F.explode(days).alias("date"))


@query("f04_typed_days", """
SELECT o_orderkey AS uuid, strftime(make_date(2024, month(o_orderdate), day(o_orderdate)), '%Y-%m-%d') AS day FROM orders""")
def f04_typed(spark, sf):
    shown = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.substring(_month(), 1, 3))
    day = F.get(dates.expand_to_days(shown, as_of()), 0)
    return _orders(spark, sf).select("uuid", day.cast("string").alias("day"))


@query("f05_year_rollover", f"""
SELECT o_orderkey AS uuid, {_LABEL.format(y="CASE WHEN month(o_orderdate) <= 3 THEN 2025 ELSE 2024 END", d="day(o_orderdate)")}
  AS date FROM orders""")
def f05(spark, sf):
    shown = F.format_string("%s - %d", _month(), F.dayofmonth("o_orderdate"))
    return _orders(spark, sf).select("uuid", F.get(dates.expand_dates(shown, as_of(LATE)), 0).alias("date"))


@query("f06_date_from_title", f"""
SELECT o_orderkey AS uuid, {_LABEL.format(y="CASE WHEN month(o_orderdate) <= 3 THEN 2025 ELSE 2024 END", d="day(o_orderdate)")}
  AS date FROM orders""")
def f06(spark, sf):
    title = F.format_string("Gala %d %s Konseri", F.dayofmonth("o_orderdate"), _month())
    return _orders(spark, sf).select("uuid", dates.date_from_title(title, as_of(LATE)).alias("date"))


@query("f07_month_number", "SELECT o_orderkey AS uuid, month(o_orderdate) AS full, month(o_orderdate) AS short FROM orders")
def f07(spark, sf):
    full, short = dates.month_number(_month()), dates.month_number(F.substring(_month(), 1, 3))
    return _orders(spark, sf).select("uuid", full.cast("long").alias("full"), short.cast("long").alias("short"))


@query("f08_parse_date", """
SELECT o_orderkey AS uuid, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN strftime(o_orderdate, '%m-%d') <> '02-29' THEN strftime(o_orderdate, '2026-%m-%d') END AS day FROM orders""")
def f08(spark, sf):
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    status = F.col("o_orderstatus")
    shown = (
        F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
        .when(status == "O", F.concat_ws(" ", year, _month(), day)).otherwise(F.concat_ws(" ", day, _month(), F.lit("7")))
    )
    return _orders(spark, sf).select("uuid", F.date_format(dates.parse_date(shown), "yyyy-MM-dd").alias("day"))


@query("f09_date_keys", """
SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-W%W') AS week, isodow(ts) - 1 AS dow, hour(ts) AS hour FROM events""")
def f09(spark, sf):
    ts = F.col("ts")
    return read_table(spark, sf, "events").select(
        "event_id", dates.month_key(ts).alias("month"), dates.week_key(ts).alias("week"),
        F.weekday(ts).cast("long").alias("dow"), F.hour(ts).cast("long").alias("hour"),
    )


@query("f23_dated_text", """
SELECT o_orderkey AS uuid, day(o_orderdate) || ' ' || """ + MONTHS_SQL + """[month(o_orderdate)] || ' '
  || CASE WHEN o_orderstatus = 'P' THEN 2024 ELSE year(o_orderdate) END AS found FROM orders""")
def f23(spark, sf):
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    shown = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("on "), F.concat_ws(" ", day, _month()), F.lit(" only"))).otherwise(
        F.concat(F.lit("Vizyon Tarihi "), F.concat_ws(" ", day, _month(), year), F.lit(" Cuma")))
    return _orders(spark, sf).select("uuid", dates.dated_text(shown, as_of()).alias("found"))


@query("f33_slash_date", "SELECT o_orderkey AS uuid, strftime(o_orderdate + INTERVAL 9131 DAY, '%Y-%m-%d') AS day FROM orders")
def f33(spark, sf):
    shifted = F.date_add(F.col("o_orderdate").cast("date"), 9131)
    shown = F.concat(F.lit("Sal, "), F.date_format(shifted, "dd/MM/yy"), F.lit(" -"))
    return _orders(spark, sf).select("uuid", dates.slash_date(shown).cast("string").alias("day"))


@query("f37_iso_round_trip", "SELECT event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def f37(spark, sf):
    iso = dates.to_iso(F.col("ts").cast("timestamp"))
    return read_table(spark, sf, "events").select("event_id", F.unix_micros(dates.from_iso(iso)).alias("us"), iso.alias("iso"))


@query("f38_fill_date", f"""
SELECT o_orderkey AS uuid, CASE o_orderstatus WHEN 'F' THEN 'listed' WHEN 'O'
  THEN {_LABEL.format(y="'2024'", d="day(o_orderdate)")} END AS date FROM orders""")
def f38(spark, sf):
    listed = F.when(F.col("o_orderstatus") == "F", "listed").otherwise("  ")
    title = F.when(F.col("o_orderstatus") == "O", F.format_string("%d %s Konseri", F.dayofmonth("o_orderdate"), _month()))
    return _orders(spark, sf).select("uuid", dates.fill_date(listed, title, as_of()).alias("date"))


# Places, ratings, replies ----------------------------------------------------------------------------------------------


@query("f18_split_venue", """
SELECT c_custkey AS uuid, CASE WHEN c_nationkey < 5 THEN c_name || ' Ankara' ELSE c_name END AS venue,
  CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey < 10 THEN 'İzmir' WHEN c_nationkey < 15 THEN 'Bursa' ELSE c_mktsegment END AS city
FROM customer""")
def f18(spark, sf):
    key, name = F.col("c_nationkey"), F.col("c_name")
    full = (
        F.when(key < 5, F.concat(name, F.lit(" Ankara"))).when(key < 10, F.concat(name, F.lit(", İzmir")))
        .when(key < 15, F.concat(name, F.lit(", Bursa"))).otherwise(F.concat(name, F.lit(", "), "c_mktsegment"))
    )
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("uuid"), places.split_venue(full).alias("v")).select("uuid", "v.*")


@query("f19_ratings", """
SELECT l_orderkey AS uuid, l_linenumber AS line, l_quantity / 10 AS rating, CAST(l_partkey AS INT) AS n FROM lineitem""")
def f19(spark, sf):
    shown = F.concat(F.lit('"'), F.replace((F.col("l_quantity") / 10).cast("string"), F.lit("."), F.lit(",")), F.lit('" '))
    count = F.format_string("(%d Yorum)", "l_partkey")
    return read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("uuid"), F.col("l_linenumber").alias("line"),
        places.parse_rating(shown).alias("rating"), places.parse_rating_count(count).alias("n"),
    )


@query("f16_decode_list", "SELECT doc_id, lang || ',' || source AS items FROM documents")
def f16(spark, sf):
    items = F.to_json(F.array("lang", "source"))
    reply = (
        F.when(F.col("lang") == "en", items).when(F.col("lang") == "fr", F.concat(F.lit('{"note": 1, "winners": '), items, F.lit("}")))
        .otherwise(F.concat(F.lit('{"other": '), items, F.lit("}")))
    )
    return read_table(spark, sf, "documents").select("doc_id", F.array_join(replies.decode_list(reply), ",").alias("items"))


@query("f16_decode_people", """
SELECT l_orderkey AS uuid, l_linenumber AS line, l_returnflag AS name, l_linestatus AS role FROM lineitem""")
def f16_people(spark, sf):
    one = F.to_json(F.struct(F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("role")))
    reply = F.when(F.col("l_linestatus") == "O", one).otherwise(F.concat(F.lit('{"key_people": ['), one, F.lit("]}")))
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("uuid"), F.col("l_linenumber").alias("line"), F.inline(replies.decode_people(reply))
    )
    return rows.select("uuid", "line", "name", "role")


@query("f39_decode_reply", """
SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(n_chars AS DOUBLE) END AS score, CASE WHEN lang = 'en' THEN source END AS vibe FROM documents""")
def f39(spark, sf):
    good = F.to_json(F.struct(F.col("n_chars").cast("double").alias("score"), F.col("source").alias("vibe")))
    reply = F.when(F.col("lang") == "en", good).when(F.col("lang") == "fr", '{"vibe": "x"}').otherwise("no json")
    parsed = replies.decode_reply(reply, "struct<score: double, vibe: string>", ["score"])
    return read_table(spark, sf, "documents").select("doc_id", parsed.alias("r")).select("doc_id", "r.score", "r.vibe")


@query("f36_venue_defaults", """
SELECT s_name AS name, s_nationkey < 5 AS is_outdoors, CASE WHEN s_nationkey < 5 THEN 'Modern' ELSE 'Unknown' END AS vibe,
       CASE WHEN s_nationkey < 5 THEN s_nationkey ELSE 0 END AS capacity FROM supplier""")
def f36(spark, sf):
    known = F.col("s_nationkey") < 5
    answered = read_table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.when(known, F.lit(True)).alias("is_outdoors"), F.when(known, "Modern").alias("vibe"),
        F.when(known, F.col("s_nationkey")).alias("capacity"),
    )
    return answered.select("name", *enrich.venue_defaults())


@query("f13_context_text", with_sql(b.ARTICLES, b.CREW) + """
, pl AS (SELECT event_uuid, role, string_agg(s_name, ', ' ORDER BY s_name) AS names
         FROM (SELECT DISTINCT event_uuid, role, s_name FROM crew JOIN supplier ON s_suppkey = person_uuid) GROUP BY ALL),
p AS (SELECT event_uuid, string_agg(role || ': ' || names, chr(10) ORDER BY role || ': ' || names) AS people FROM pl GROUP BY 1)
, rev AS (SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS t FROM conversations
          QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5),
r AS (SELECT conv_id, string_agg('- ' || t, chr(10) ORDER BY turn) AS reviews FROM rev GROUP BY conv_id)
SELECT uuid, 'Title: ' || title || chr(10) || 'Category: ' || category || chr(10) || 'Genre: Unknown' || chr(10)
  || 'Duration: Unknown' || chr(10) || 'Description: ' || description || chr(10) || 'Venue: ' || venue
  || chr(10) || 'City: Unknown city' || chr(10) || 'Price: ' || CAST(price AS VARCHAR) || chr(10)
  || coalesce('KEY PEOPLE (Verified):' || chr(10) || people, '') || chr(10)
  || coalesce('TOP USER REVIEWS:' || chr(10) || reviews, 'No reviews available.') AS context
FROM articles LEFT JOIN r ON conv_id = uuid LEFT JOIN p ON p.event_uuid = uuid""")
def f13(spark, sf):
    return enrich.add_context(b.articles(spark, sf), *_texts(spark, sf)).select("uuid", "context")


def _texts(spark, sf):
    """(reviews, people) of events: conversations, and the named crew."""
    content = read_table(spark, sf, "conversations").withColumnRenamed("conv_id", "event_uuid")
    named = b.crew(spark, sf).join(b.people(spark, sf).withColumnRenamed("uuid", "person_uuid"), "person_uuid")
    return enrich.review_text(content, "turn"), enrich.people_text(named)


# Pages -----------------------------------------------------------------------------------------------------------------


def _decoded(c: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("s04_article_pages", f"""
SELECT page_id, {_decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  len(regexp_extract_all(html, '<li><a href=')) AS n_links FROM pages""")
def s04(spark, sf):
    df = pages.article_pages(read_table(spark, sf, "pages"))
    return df.select("page_id", "title", "lang", F.size("links").alias("n_links"))


@query("f20_page_titles", f"""
SELECT page_id, {_decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title FROM pages""")
def f20(spark, sf):
    f = pages.extract_fields(read_table(spark, sf, "pages"), {"h2": ("h2 a", "own"), "t": ("head > title", "text")})
    return f.select("page_id", pages.first("h2", "t").alias("title"))


@query("f21_page_links", f"""
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || {_decoded('link')} AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS link FROM pages)""")
def f21(spark, sf):
    links = pages.article_pages(read_table(spark, sf, "pages")).select("page_id", "url", F.explode("links").alias("link"))
    return links.select("page_id", places.absolute_url(F.col("link"), F.col("url")).alias("link"))


@query("f22_entity_decoding", f"""
SELECT page_id, {_decoded("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")} AS footer FROM pages""")
def f22(spark, sf):
    return pages.article_pages(read_table(spark, sf, "pages")).select("page_id", "footer")


def _joined(parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def tour_pages(spark, sf):
    """One tour page per customer: a city block with a dated row per order."""
    day = F.format_string("%d %s", F.dayofmonth("o_orderdate"), _month())
    row = _joined(['<div class="ed-biletler__sehir__gun"><time class="ed-biletler__sehir__gun__tarih">', day,
                   '</time><a itemprop="location" title="', F.col("o_orderpriority"), '">x</a>'
                   '<div class="ed-biletler__sehir__gun__fiyat">', _turkish(F.col("o_totalprice")), "</div></div>"])  # fmt: skip
    rows = _orders(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    joined = rows.join(read_table(spark, sf, "customer"), "c_custkey")
    html = _joined(["<html><body><h2><a href='/x'>", F.col("c_name"), '</a></h2><div data-sehir="', F.col("c_mktsegment"), '">',
                    F.col("rows"), "</div></body></html>"])
    return joined.select(F.col("c_custkey").alias("page_id"), F.lit("https://site.example/t").alias("url"), html.alias("html"))


@query("f24_tour_rows", f"""
SELECT o_custkey AS page_id, c_name AS title, o_orderpriority AS venue, c_mktsegment AS city,
       {_LABEL.format(y="'2024'", d="day(o_orderdate)")} AS date, o_totalprice AS price
FROM orders JOIN customer ON c_custkey = o_custkey""")
def f24(spark, sf):
    detail = pages.site_a_detail(tour_pages(spark, sf), as_of(), fields=pages.EVENT_FIELDS)
    return pages.site_a_events(detail, as_of()).select("page_id", "title", "venue", "city", "date", "price")


def _spread(df, key):
    """Rows that are small but take long to render and walk: with a stated number, AQE does not merge parts by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))


def event_pages(spark, sf):
    """One single-event page per order: labels, date range, price element, sold-out mark, credits, description."""
    df = _spread(_orders(spark, sf), "uuid")
    day = F.dayofmonth("o_orderdate")
    dated = F.format_string("%s - %02d - %02d", _month(), day, (day + F.col("o_custkey") % 3).cast("int"))
    sold = F.when(F.col("o_orderstatus") == "P", "<button>TÜKENDİ</button>").otherwise("")
    html = _joined([
        "<html><body><h3><a>Event ", F.col("o_orderkey").cast("string"), '</a></h3><div class="yds_cinema_movie_thread_info"><p>Kind ',
        F.col("o_orderpriority"), "</p><p><strong>Yönetmen:</strong> Person ", F.col("o_custkey").cast("string"), ", Helper",
        '</p></div><div class="yds_cinema_movie_thread_detail"><ul><li><strong>Etkinlik Türü</strong> <span>Genre ', F.col("o_orderstatus"),
        "</span></li><li><strong>Süre</strong> <span>", F.month("o_orderdate").cast("string"), '0 dakika</span></li></ul></div><p class="event-date">',
        dated, '</p><span class="bilet-fiyati">', _turkish(F.col("o_totalprice")), "</span>", sold, "</body></html>",
    ])
    return df.select(F.col("o_orderkey").alias("page_id"), F.lit("https://site.example/e").alias("url"), html.alias("html"))


@query("f25_date_fan_out", f"""
SELECT o_orderkey AS page_id, {_LABEL.format(y="'2024'", d="d")} AS date FROM orders,
LATERAL (SELECT unnest(range(day(o_orderdate), day(o_orderdate) + 1 + o_custkey % 3)) AS d)""")
def f25(spark, sf):
    detail = pages.site_a_detail(event_pages(spark, sf), as_of(), fields=pages.EVENT_FIELDS)
    return pages.site_a_events(detail, as_of()).select("page_id", "date")


@query("f30_labelled_fields", """
SELECT o_orderkey AS page_id, 'Kind ' || o_orderpriority AS category, 'Genre ' || o_orderstatus AS genre,
       month(o_orderdate) || '0 dakika' AS duration FROM orders""")
def f30(spark, sf):
    return pages.site_a_detail(event_pages(spark, sf), as_of(), fields=("category", "genre", "duration",)).drop("url")


@query("f32_sold_out_price", """
SELECT o_orderkey AS page_id, o_orderstatus = 'P' AS sold_out, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders""")
def f32(spark, sf):
    return pages.site_a_detail(event_pages(spark, sf), as_of(), fields=("sold_out", "price",)).drop("url")


@query("f27_descriptions", """
SELECT o_orderkey AS page_id, 'Kind ' || o_orderpriority || ' Yönetmen: Person ' || o_custkey || ', Helper' AS description FROM orders""")
def f27(spark, sf):
    return pages.site_a_detail(event_pages(spark, sf), as_of(), fields=("description",)).drop("url")


@query("f28_credits", """
SELECT o_orderkey AS page_id, 'Person ' || o_custkey AS name, 'DIRECTED' AS role FROM orders
UNION ALL SELECT o_orderkey, 'Helper', 'DIRECTED' FROM orders""")
def f28(spark, sf):
    return pages.credit_rows(pages.site_a_detail(event_pages(spark, sf), as_of(), fields=("credits",)))


def comment_pages(spark, sf):
    """One page per conversation: system and assistant turns as the site's summary, user turns as comments."""
    body = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    comment = _joined(['<div class="yds_cinema_movie_yorum_person"><strong>', F.format_string("%s %d", "role", "turn"),
                       "</strong><p>SEYİRCİ</p><p>", body, '</p><span class="puan">', F.col("turn").cast("string"), ",5</span></div>"])
    turns = read_table(spark, sf, "conversations")
    grouped = turns.groupBy("conv_id").agg(F.array_join(F.collect_list(comment), "").alias("c"))
    html = _joined(['<body><h2><a>x</a></h2><div class="yds_comment_container">', F.col("c"), "</div></body>"])
    return grouped.select(F.col("conv_id").alias("page_id"), F.lit("https://site.example/c").alias("url"), html.alias("html"))


@query("f26_reviews", """
SELECT conv_id AS page_id, 'user_review' AS content_type, role || ' ' || turn AS author,
       trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CAST(turn + 0.5 AS DOUBLE) AS rating FROM conversations
WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 10 AND NOT contains(text, 'SEYİRCİ')""")
def f26(spark, sf):
    return pages.review_rows(pages.site_a_detail(comment_pages(spark, sf), as_of(), fields=("reviews",)))


@query("f29_name_patterns", """
SELECT c_custkey AS page_id, CASE WHEN c_nationkey < 12 THEN 'Deniz Ak Tek Kişilik' ELSE 'Ece Su' END AS name, 'PERFORMED_BY' AS role FROM customer""")
def f29(spark, sf):
    words = F.when(F.col("c_nationkey") < 12, "Deniz Ak Tek Kişilik Stand Up").otherwise("Sahne Alan: Ece Su")
    html = _joined(['<body><div class="yds_cinema_movie_thread_info"><p>bu akşam ', words, "</p></div></body>"])
    rows = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("page_id"), F.lit("https://site.example/s").alias("url"), html.alias("html")
    )
    return pages.credit_rows(pages.site_a_detail(rows, as_of(), fields=("credits",)))


# Enrichment with a deterministic stand-in for the caller's model -------------------------------------------------------


def stand_in_model(batches):
    """Scores by context length; no reply for French texts, broken reply for Spanish ones."""
    for batch in batches:
        size = batch["context"].str.len()
        reply = '{"refined_category": "Concert", "quality_score": ' + (size % 10).astype(str) + ', "sentiment_summary": "ok"}'
        lang = batch["context"].str.extract(r"Category: (\w+)")[0]
        yield batch.assign(reply=reply.where(lang != "es", "oops").where(lang != "fr"))[["uuid", "reply"]]


@query("v06_enrichment", with_sql(b.ARTICLES, b.REVIEWS, b.CREW) + """
, s AS (SELECT uuid, category, event_uuid IS NOT NULL AS done, (uuid % 4 <> 0 AND length(trim(description)) > 10) OR uuid IN (SELECT conv_id FROM conversations)
         OR uuid IN (SELECT event_uuid FROM crew) AS ready
        FROM articles LEFT JOIN reviews ON event_uuid = uuid)
SELECT uuid, CASE WHEN done THEN 'skipped' WHEN NOT ready THEN 'skipped_low_quality'
  WHEN category IN ('es', 'fr') THEN 'failed' ELSE 'success' END AS state,
  CASE WHEN NOT done AND ready AND category NOT IN ('es', 'fr') THEN 'Concert' ELSE category END AS category FROM s""")
def v06(spark, sf):
    return _enriched(spark, sf).select("uuid", "state", "category")


def _enriched(spark, sf):
    content = read_table(spark, sf, "conversations").withColumnRenamed("conv_id", "event_uuid")
    # short descriptions only, so that reviews and people decide for many events
    events = b.articles(spark, sf).withColumn("description", F.when(F.col("uuid") % 4 != 0, F.col("description")))
    chosen = enrich.select_for_enrichment(events, b.reviews(spark, sf), content, b.crew(spark, sf))
    return enrich.enrich(enrich.add_context(chosen, *_texts(spark, sf)), stand_in_model)


@query("a32_outcomes", with_sql(b.ARTICLES, b.REVIEWS, b.CREW) + """
SELECT CASE WHEN event_uuid IS NOT NULL THEN 'skipped' WHEN NOT ((uuid % 4 <> 0 AND length(trim(description)) > 10) OR uuid IN (SELECT conv_id FROM conversations)
         OR uuid IN (SELECT event_uuid FROM crew)) THEN 'skipped_low_quality'
  WHEN category IN ('es', 'fr') THEN 'failed' ELSE 'success' END AS state, count(*) AS n
FROM articles LEFT JOIN reviews ON event_uuid = uuid GROUP BY state""")
def a32(spark, sf):
    return enrich.outcomes(_enriched(spark, sf))


def stand_in_people(batches):
    """Names the first word of the title; French texts get a wrapped list with an unnamed entry."""
    for batch in batches:
        word = batch["title"].str.split(" ").str[0]
        one = '[{"name": "' + word + '", "role": "WROTE"}]'
        yield batch.assign(reply=one.where(word != "fr", '{"people": [{"name": "F", "role": "CREW"}, {"role": "X"}]}'))[["uuid", "reply"]]


@query("v07_entities", with_sql(b.ARTICLES) + """
SELECT uuid AS event_uuid, CASE category WHEN 'fr' THEN 'F' ELSE category END AS name,
       CASE category WHEN 'fr' THEN 'CREW' ELSE 'WROTE' END AS role FROM articles WHERE length(description) >= 20""")
def v07(spark, sf):
    return enrich.extract_people(b.articles(spark, sf), stand_in_people)


def stand_in_venues(batches):
    for batch in batches:
        big = batch["name"].str.len() > 4
        yield batch.assign(is_outdoors=big, vibe=batch["name"].str.upper(), capacity=batch["name"].str.len().astype("int32"))[
            ["name", "is_outdoors", "vibe", "capacity"]
        ]


@query("v08_venues", with_sql(b.ARTICLES) + """
SELECT DISTINCT venue AS name, length(venue) > 4 AS is_outdoors, upper(venue) AS vibe, CAST(length(venue) AS INT) AS capacity
FROM articles WHERE venue <> 'src0'""")
def v08(spark, sf):
    events = b.articles(spark, sf)
    known = events.filter("venue = 'src0'").select(F.col("venue").alias("name")).distinct()
    return enrich.enrich_venues(events, known, stand_in_venues).select("name", "is_outdoors", "vibe", "capacity")


# Listing pages: two cards per supplier, each in one of three layouts, so that every fallback is met.


def _listing_pages(spark, sf):
    k, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    nation = F.col("n_name")
    day = F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0")
    cards = [
        _joined(['<li><h2><a href="/ev/', k, '">', name, '</a></h2><div class="sehir-detay__liste__alt__adres">', nation,
                 ' İstanbul</div><img data-src="//img.example/', k, '.jpg" src="data:x"><span class="sehir-detay__liste__ust__tip">Konser'
                 '</span><div class="etkinlikler_container_puan_list"><strong>4,', (F.col("s_suppkey") % 10).cast("string"),
                 "</strong><span>(", k, " Yorum)</span></div></li>"]),
        _joined(['<li><h3><a href="ev/', k, '">', name, "</a></h3><address>", nation, "</address><span>Aralık - ", day,
                 '</span><img src="/i/', k, '.png"></li>']),
        _joined(["<li><figure><figcaption><span>", name, "</span><small>Tiyatro</small><time>", day, ' Ocak</time></figcaption></figure><p class="loca">',
                 nation, '</p><a href="https://other.example/', k, '">x</a></li>']),
    ]

    def layout(offset):
        n = (F.col("s_suppkey") + offset) % 3
        return F.when(n == 0, cards[0]).when(n == 1, cards[1]).otherwise(cards[2])

    suppliers = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    html = _joined(["<html><body><ul>", layout(0), layout(1), "</ul></body></html>"])
    return suppliers.select(F.col("s_suppkey").alias("page_id"), F.lit("https://site.example/list/x").alias("url"), html.alias("html"))


@query("f20_listing_a", """
WITH c AS (SELECT s_suppkey AS k, s_name, n_name, (s_suppkey + o) % 3 AS v, lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') AS day
           FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest([0, 1]) AS o))
SELECT k AS page_id, s_name AS title, CASE v WHEN 0 THEN n_name || ' İstanbul' ELSE n_name END AS venue,
       CASE v WHEN 0 THEN 'İstanbul' END AS city,
       CASE v WHEN 0 THEN NULL WHEN 1 THEN '{year} Aralık ' || day ELSE '{next} Ocak ' || day END AS date,
       CASE v WHEN 0 THEN 'https://site.example/ev/' || k WHEN 1 THEN 'https://site.example/list/ev/' || k
              ELSE 'https://other.example/' || k END AS url,
       CASE v WHEN 0 THEN 'https://img.example/' || k || '.jpg' WHEN 1 THEN 'https://biletinial.com/i/' || k || '.png' END AS image_url,
       CASE v WHEN 0 THEN 'Konser' WHEN 1 THEN 'Etkinlik' ELSE 'Tiyatro' END AS category,
       CASE v WHEN 0 THEN 4 + k % 10 / 10.0 END::DOUBLE AS rating, CASE v WHEN 0 THEN k END::INT AS rating_count
FROM c""".replace("{year}", "2025").replace("{next}", "2026"))
def f20_listing_a(spark, sf):
    items = pages.site_a_listing(_listing_pages(spark, sf), F.lit("2025-12-01").cast("timestamp"))
    return items.drop("card_pos")


def _site_b_pages(spark, sf):
    """One listing card and one price block per part, in alternating layouts."""
    k, name, even = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_partkey") % 2 == 0
    day = F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")
    info = _joined(['<div class="searchResultInfo3"><span class="ln1">', F.when(even, _joined(["Cum, ", day, "/12/25 -"])).otherwise(name),
                    '</span><span class="ln1">', F.when(even, F.lit("Hall")).otherwise(_joined(["Sal, ", day, "/11/25"])), "</span></div>"])
    card = _joined(['<div class="searchResultEvent">', F.when(even, _joined(['<a class="searchResultEventNameMobile" href="/e/', k, '">', name, "</a>"])).otherwise(
                        _joined(['<a href="//site.example/f/', k, '">more</a>'])), info,
                    '<span class="searchResultCity">', F.col("p_brand"), "</span>", F.when(even, _joined(['<img data-src="/i/', k, '.png">'])).otherwise(
                        _joined(['<div style="background-image: url(', "'//img.example/", k, ".jpg')", '"></div>'])), "</div>"])
    shown = F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(","))
    price = F.when(even, _joined(['<div class="event-price">', shown, " TL</div>"])).otherwise(
        _joined(['<div id="buy-tickets">2 left, ', shown, " TL only</div>"]))
    html = _joined(["<html><body>", card, price, "</body></html>"])
    return _spread(read_table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.lit("https://site.example/s").alias("url"), html.alias("html"))


@query("f21_listing_b", """
WITH c AS (SELECT p_partkey AS k, p_name, p_brand, p_partkey % 2 = 0 AS even, lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS day FROM part)
SELECT k AS page_id, p_name AS title, CASE WHEN even THEN 'Hall' ELSE 'Sal, ' || day || '/11/25' END AS venue, p_brand AS city,
       CASE WHEN even THEN 'Cum, ' || day || '/12/25' ELSE 'Sal, ' || day || '/11/25' END AS date_raw,
       CASE WHEN even THEN ('2025-12-' || day)::DATE ELSE ('2025-11-' || day)::DATE END AS event_date,
       CASE WHEN even THEN 'https://site.example/e/' || k ELSE 'https://site.example/f/' || k END AS url,
       CASE WHEN even THEN '/i/' || k || '.png' ELSE 'https://img.example/' || k || '.jpg' END AS image_url FROM c""")
def f21_listing_b(spark, sf):
    return pages.site_b_listing(_site_b_pages(spark, sf)).drop("card_pos")


@query("f31_site_b_price", "SELECT p_partkey AS page_id, round(p_retailprice, 2) AS price FROM part")
def f31_site_b_price(spark, sf):
    return pages.site_b_price(_site_b_pages(spark, sf)).select("page_id", F.round("price", 2).alias("price"))
