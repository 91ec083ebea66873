"""Stored tables. Nulls stay null in storage; defaults are applied by the normalising projections."""

EVENTS = """
uuid string, title string, description string, date_raw string, event_date date, event_ts timestamp, venue string,
city string, price double, price_range string, category_prices array<struct<name: string, price: double>>,
url string, image_url string, category string, genre string, duration string, source string,
created_at timestamp, updated_at timestamp
"""

CONTENT = """
uuid string, event_uuid string, content_type string, text string, summary string, rating double, rating_count int,
author string, language string, sentiment_score double, keywords array<string>, likes_count int, views_count int,
helpful_count int, created_at timestamp, updated_at timestamp
"""

SUMMARY = """
uuid string, event_uuid string, quality_score double, importance string, value_rating string,
sentiment_summary string, key_highlights array<string>, concerns array<string>, best_for array<string>, vibe string,
uniqueness string, educational_value boolean, tourist_attraction boolean, bucket_list_worthy boolean,
embedding array<float>, created_at timestamp, updated_at timestamp
"""

VENUE = """
uuid string, name string, city string, address string, coordinates string, is_outdoors boolean, capacity int,
vibe string
"""

PERSON = "uuid string, name string, known_for string"
PERSON_EVENT = "person_uuid string, event_uuid string, role string"
COLLECTION = "uuid string, name string, description string, category string, updated_at timestamp"
COLLECTION_EVENT = "category string, event_uuid string, rank int, reason string, added_at timestamp"
SAME_AS = "uuid_a string, uuid_b string, score double, updated_at timestamp"

# Items as they land from the crawl.
ITEM = """
uuid string, title string, description string, date string, venue string, city string, price string,
price_range string, category_prices string, url string, image_url string, category string, genre string,
duration string, source string, rating double, rating_count int,
reviews array<struct<content_type: string, text: string, author: string, rating: double>>,
extracted_entities array<struct<name: string, role: string>>, is_update_job boolean, scraped_at timestamp
"""

# Roles an edge from a person to an event may have, and the stand-in category.
ROLES = ("WROTE", "DIRECTED", "ACTED_IN", "PERFORMED_BY", "COMPOSED", "CONDUCTED", "CREW")
DEFAULT_CATEGORY = "Etkinlik"
