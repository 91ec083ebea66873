"""Price text to double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values.
FREE_WORDS = ("free", "ücretsiz", "bedava")
CURRENCY = ("TL", "₺")
TICKET_PRICE_KEYS = ("price", "satis_fiyati", "fiyat", "amount", "tutar")
CINEMA_WORD = "sinema"
CINEMA_PRICE = 250.0
MAX_PRICE = 100_000

_NUMBER = r"(\d+(?:\.\d+)?)"


def _without(c: Column, *tokens: str) -> Column:
    return reduce(lambda acc, t: F.replace(acc, F.lit(t), F.lit("")), tokens, c)


def _first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _NUMBER, 1), F.lit("")).try_cast("double")


def parse_price(c: Column, locale: str = "dot") -> Column:
    """First number of a price text.

    ``dot``: comma and dot are both decimal marks, words for free give 0. ``tr``: dot groups, comma is decimal.
    """
    if locale == "tr":
        return _first_number(F.replace(_without(c, ".", *CURRENCY), F.lit(","), F.lit(".")))
    if locale != "dot":
        raise ValueError(f"unknown locale {locale!r}")
    text = F.trim(F.replace(_without(c, *CURRENCY), F.lit(","), F.lit(".")))
    free = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in FREE_WORDS])
    return F.when(c == "", None).when(free, F.lit(0.0)).otherwise(_first_number(text))


def price_in_text(c: Column) -> Column:
    """'… 150,00 TL …' -> 150.0; only a number with two decimals right before TL counts."""
    return parse_price(F.nullif(F.regexp_extract(c, r"(\d+[,.]\d{2})\s*TL", 1), F.lit("")))


def valid_price(c: Column, max_price: float = MAX_PRICE) -> Column:
    """Numeric and inside [0, max]; anything else is null. Text that is not a number is null too."""
    number = c.try_cast("double")
    return F.when(number.between(0, max_price), number)


def ticket_prices(c: Column) -> Column:
    """Ticket JSON to array<struct<name, price>>: ``{"prices": [{name, price}]}``, Turkish price text."""
    schema = "struct<prices: array<struct<name: string, price: string>>>"
    items = F.from_json(c, schema)["prices"]
    # a JSON number arrives as its digits: one or two decimals after a point are no thousands group
    def amount(v: Column) -> Column:
        return F.when(v.rlike(r"^\d+\.\d{1,2}$"), v.try_cast("double")).otherwise(parse_price(v, "tr"))

    priced = F.transform(items, lambda p: F.struct(p["name"].alias("name"), amount(p["price"]).alias("price")))
    return F.filter(priced, lambda p: p["price"].isNotNull())


def _loose_values(c: Column) -> Column:
    """Prices in a map or list of numbers, texts or objects; only positive ones are kept."""
    as_text = F.coalesce(F.map_values(F.from_json(c, "map<string,string>")), F.from_json(c, "array<string>"))

    def one(v: Column) -> Column:
        inner = F.from_json(v, "map<string,string>")
        keyed = F.coalesce(*[F.replace(inner[k], F.lit(","), F.lit(".")) for k in TICKET_PRICE_KEYS]).try_cast("double")
        plain = F.when(v.rlike(r"^-?\d+(\.\d+)?$") & ~F.contains(v, F.lit(",")), v.try_cast("double"))
        grouped = F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
        return F.when(F.startswith(v, F.lit("{")), keyed).otherwise(F.coalesce(plain, grouped))

    return F.filter(F.transform(as_text, one), lambda p: p > 0)


def min_ticket_price(c: Column) -> Column:
    """Lowest price anywhere in the ticket JSON, null when it holds none."""
    named = F.transform(ticket_prices(c), lambda p: p["price"])
    empty = F.array().cast("array<double>")
    return F.array_min(F.concat(F.coalesce(named, empty), F.coalesce(_loose_values(c), empty)))


def cinema_price(price: Column, event_type: Column, url: Column) -> Column:
    """Cinema listings hide their price: apply the fixed default."""
    is_cinema = F.contains(F.lower(F.coalesce(event_type, F.lit(""))), F.lit(CINEMA_WORD)) | F.contains(
        F.lower(F.coalesce(url, F.lit(""))), F.lit(CINEMA_WORD)
    )
    return F.when(is_cinema, F.lit(CINEMA_PRICE)).otherwise(price)
