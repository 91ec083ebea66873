"""Venue, city, genre, rating and url helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Cities a venue text is checked against, in order of preference.
KNOWN_CITIES = ("İstanbul", "Ankara", "İzmir", "Antalya", "Bursa", "Eskişehir", "Muğla", "Adana", "Mersin")

# User terms and the stored genre they mean.
GENRES = {
    "stand-up": "Stand up", "stand up": "Stand up", "standup": "Stand up", "stand-up comedy": "Stand up",
    "komedi": "Stand up", "jazz": "Caz", "caz": "Caz", "rock": "Rock", "pop": "Pop", "classical": "Klasik",
    "klasik": "Klasik", "classical music": "Klasik", "theater": "Tiyatro", "theatre": "Tiyatro",
    "tiyatro": "Tiyatro", "play": "Tiyatro", "drama": "Dram", "dram": "Dram", "concert": "Konser",
    "konser": "Konser", "opera": "Opera", "ballet": "Bale", "bale": "Bale",
}

# Moods that are not genres.
MOODS = (
    "romantic", "romantik", "fun", "eğlenceli", "family", "aile", "family-friendly", "date", "date night", "cheap",
    "ucuz", "expensive", "pahalı", "popular", "popüler", "hidden", "hidden gem", "unique", "benzersiz", "cultural",
    "kültürel", "tourist", "turist",
)


def normalize_genre(c: Column, mapping: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for pair in (mapping or GENRES).items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.lower(c)], c)


def drop_mood(c: Column) -> Column:
    """Null when the value is a mood word, else the value."""
    return F.when(~F.lower(c).isin(*MOODS), c)


def filter_term(c: Column) -> Column:
    """A search term for genre or category: synonyms resolved, moods removed."""
    return drop_mood(normalize_genre(F.nullif(c, F.lit(""))))


def split_venue(c: Column) -> Column:
    """'Venue, City' -> struct<venue, city>, split at the last comma; an unknown city is looked up in the text."""
    head = F.coalesce(F.nullif(F.regexp_extract(c, r"^(.*),([^,]*)$", 1), F.lit("")), F.nullif(c, F.lit("")))
    tail = F.nullif(F.trim(F.regexp_extract(c, r"^(.*),([^,]*)$", 2)), F.lit(""))
    cities = F.array(*[F.lit(x) for x in KNOWN_CITIES])
    tail_known = reduce(lambda a, b: a | b, [F.contains(tail, F.lit(x)) for x in KNOWN_CITIES])
    inside = F.get(F.filter(cities, lambda x: F.contains(c, x)), 0)
    corrected = tail.isNotNull() & ~tail_known & inside.isNotNull()
    without = F.replace(F.replace(c, F.concat(F.lit(", "), inside), F.lit("")), inside, F.lit(""))
    venue = F.when(corrected & F.endswith(c, inside), F.trim(F.trim(without), F.lit(","))).otherwise(F.trim(head))
    city = F.when(corrected, inside).otherwise(tail)
    return F.struct(venue.alias("venue"), city.alias("city"))


def city_in(c: Column, cities: tuple[str, ...] = KNOWN_CITIES[:6]) -> Column:
    """First known city mentioned in an address."""
    return F.get(F.filter(F.array(*[F.lit(x) for x in cities]), lambda x: F.contains(c, x)), 0)


def parse_rating(c: Column) -> Column:
    """'"4,7"' -> 4.7."""
    return F.replace(F.trim(F.trim(c), F.lit('"')), F.lit(","), F.lit(".")).try_cast("double")


def parse_rating_count(c: Column) -> Column:
    """'(1121 Yorum)' -> 1121."""
    return F.nullif(F.regexp_extract(c, r"\((\d+)\s*Yorum\)", 1), F.lit("")).try_cast("int")


def absolute_url(href: Column, page_url: Column) -> Column:
    """Resolve a link against its page for absolute, protocol-relative, rooted and relative hrefs."""
    scheme = F.regexp_extract(page_url, r"^([a-z]+:)//", 1)
    origin = F.regexp_extract(page_url, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_extract(page_url, r"^([^?#]*)", 1), r"^([a-z]+://[^/]+(?:/.*)?/)", 1)
    folder = F.coalesce(F.nullif(folder, F.lit("")), F.concat(origin, F.lit("/")))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .otherwise(F.concat(folder, href))
    )


def image_url(src: Column, site: str) -> Column:
    """Image source or background style to a full url; inline data is null."""
    styled = F.nullif(F.regexp_extract(src, r"""url\(["']?([^"')]+)["']?\)""", 1), F.lit(""))
    raw = F.coalesce(styled, src)
    return (
        F.when(F.startswith(raw, F.lit("data:")), None)
        .when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw))
        .when(F.startswith(raw, F.lit("/")), F.concat(F.lit(site), raw))
        .otherwise(raw)
    )
