"""Turkish listing dates: ranges, titles, dashboards, detail pages. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month names in calendar order, full then abbreviated.
MONTHS = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran",
          "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")
SHORT_MONTHS = ("Oca", "Şub", "Mar", "Nis", "May", "Haz", "Tem", "Ağu", "Eyl", "Eki", "Kas", "Ara")
NAMED_MONTHS = tuple(zip(MONTHS + SHORT_MONTHS, list(range(1, 13)) * 2))

_YEAR = r"(?<![\p{L}\p{N}_])(20\d{2})(?![\p{L}\p{N}_])"
_ANY = "|".join(MONTHS + SHORT_MONTHS)
_MONTH_FIRST = rf"(?:{_ANY})(?: -)?(?: \d{{1,4}}(?: - \d{{1,4}})?)?"
_DAY_FIRST = rf"\d{{1,4}} (?:{_ANY})"
_RANGE_FIRST = rf"\d{{1,4}} - \d{{1,4}} (?:{_ANY})"


def month_number(name: Column) -> Column:
    """Full or abbreviated month name to 1..12, null otherwise."""
    pairs = [F.lit(x) for pair in NAMED_MONTHS for x in pair]
    return F.create_map(*pairs)[name]


def month_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), number - 1)


def roll_year(year: Column, month: Column, as_of: Column) -> Column:
    """January..March seen in November or December belongs to next year."""
    return F.when((month <= 3) & (F.month(as_of) >= 11), year + 1).otherwise(year)


def _label(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%d %s %02d", year, month_name(month), day)


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _days(c: Column, as_of: Column, strict: bool) -> Column:
    """array<struct<y, m, d>> of every day named in the text, in reading order."""
    given = _found(c, _YEAR).try_cast("int")
    text = F.replace(c, F.coalesce(given.cast("string"), F.lit("")), F.lit(""))
    text = F.trim(F.regexp_replace(F.when(given.isNull(), c).otherwise(text), r"\s+", " "))
    forms = [_MONTH_FIRST, _DAY_FIRST] if strict else [_MONTH_FIRST, _RANGE_FIRST, _DAY_FIRST]
    pattern = rf"(?<!\S)(?:{'|'.join(forms)})(?!\S)"
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    # Each step is a transform of its own: a token's month and numbers are looked up once, not once per use or day.
    def read(token: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(token, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
        return F.struct(month_number(F.regexp_extract(token, f"({_ANY})", 1)).alias("m"), numbers.alias("n"))

    def bound(t: Column) -> Column:
        year = F.coalesce(given, roll_year(F.year(as_of), t["m"], as_of))
        first = F.get(t["n"], 0)
        return F.struct(year.alias("y"), t["m"].alias("m"), first.alias("a"), F.coalesce(F.get(t["n"], 1), first).alias("b"))

    def expand(t: Column) -> Column:
        # sequence() counts down when reversed; such a range names no day.
        days = F.when(t["a"] <= t["b"], F.sequence(t["a"], t["b"])).otherwise(F.array().cast("array<int>"))
        return F.transform(days, lambda d: F.struct(t["y"].alias("y"), t["m"].alias("m"), d.alias("d")))

    return F.flatten(F.transform(F.transform(F.transform(tokens, read), bound), expand))


def expand_dates(c: Column, as_of: Column, strict: bool = False) -> Column:
    """Every day named by a range text as 'YYYY Month DD'; the input itself when none is found.

    ``strict`` keeps a narrower grammar, where 'D1 - D2 Month' yields D2 only. Months are case-exact.
    """
    days = F.coalesce(_days(c, as_of, strict), F.array().cast("array<struct<y: int, m: int, d: int>>"))
    named = F.transform(F.array(days), lambda x: F.when(
        F.size(x) > 0, F.transform(x, lambda s: _label(s["y"], s["m"], s["d"]))).otherwise(F.array(c)))
    return F.get(named, 0)


def expand_to_days(c: Column, as_of: Column, strict: bool = False) -> Column:
    """Like :func:`expand_dates`, as dates; days that do not exist (31 Şubat) are null."""
    return F.transform(
        _days(c, as_of, strict), lambda s: F.try_make_timestamp(
            s["y"], s["m"], s["d"], F.lit(0), F.lit(0), F.lit(0)).cast("date")
    )


def _folded(c: Column) -> Column:
    """Lower case with i, ı, I and İ made equal, as in a case-insensitive match of month names."""
    return F.translate(F.lower(F.translate(c, "İI", "ii")), "ı", "i")


def _folded_name(name: str) -> str:
    return name.replace("İ", "i").replace("I", "i").lower().replace("ı", "i")


def date_from_title(c: Column, as_of: Column) -> Column:
    """'… 5 Aralık …' -> 'YYYY Aralık 05'; '' when the title names no date.

    Of several dates the one whose month comes first in the table wins ('day month' before 'month day'), ignoring
    case. The January..March rollover applies even beside an explicit year.
    """
    order = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(NAMED_MONTHS) for x in (_folded_name(n), i)])

    def candidates(pattern: str, form: int) -> Column:
        tokens = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        return F.transform(
            tokens,
            lambda t, i: F.struct(
                order[_folded(F.regexp_extract(t, rf"(?iu)({_ANY})", 1))].alias("month"), F.lit(form).alias("form"),
                i.alias("at"), F.regexp_extract(t, r"(\d{1,2})", 1).cast("int").alias("day"),
            ),
        )

    both = F.concat(
        candidates(rf"(?iu)(?:\d{{1,2}})\s+(?:{_ANY})", 0), candidates(rf"(?iu)(?:{_ANY})\s+(?:\d{{1,2}})", 1)
    )
    best = F.array_min(both)
    month = best["month"] % 12 + 1
    year = F.coalesce(_found(c, _YEAR).try_cast("int"), F.year(as_of))
    return F.when(best.isNotNull(), _label(roll_year(year, month, as_of), month, best["day"])).otherwise(F.lit(""))


def _iso_date(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(
        low.rlike(r"^\d{4}-\d{2}-\d{2}([ t].*)?$"),
        F.replace(F.upper(low), F.lit("Z"), F.lit("+00:00")).try_cast("timestamp"),
    )


def parse_date(c: Column, default_year: int = 2026) -> Column:
    """ISO text, '2026 Mayıs 23' or '23 Mayıs 2026' to timestamp; null when neither or no such day."""
    low = F.lower(F.trim(c))
    iso = _iso_date(c)
    numbers = F.regexp_extract_all(low, F.lit(r"(\d+)"), F.lit(1))
    first, second = F.get(numbers, 0).try_cast("int"), F.get(numbers, 1).try_cast("int")
    year = F.when(first > 1000, first).when(second > 1000, second).otherwise(F.lit(default_year))
    day = F.when(first > 1000, second).otherwise(first)
    zero = F.lit(0)
    # Every month named in the text is tried in calendar order; the first that gives a real day wins.
    tries = F.transform(
        F.array(*[F.lit(name.lower()) for name in MONTHS]),
        lambda name, i: F.when(F.contains(low, name), F.try_make_timestamp(year, i + 1, day, zero, zero, zero)),
    )
    return F.coalesce(iso, F.when(second.isNotNull(), F.get(F.filter(tries, lambda t: t.isNotNull()), 0)))


def catalogue_timestamp(c: Column, as_of: Column) -> Column:
    """Timestamp of any stored date text: ISO, 'YYYY Month DD', or the first day of a listing range."""
    # a text without a letter names no month
    named = F.coalesce(parse_date(c), F.get(expand_to_days(c, as_of), 0).cast("timestamp"))
    return F.when(c.rlike(r"\p{L}"), named).otherwise(_iso_date(c))


def week_key(ts: Column) -> Column:
    """'%Y-W%W': weeks start on Monday, days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def slash_date(c: Column) -> Column:
    """'Sal, 02/12/25' with a trailing dash -> date."""
    return F.to_date(_found(F.rtrim(F.trim(c)), r"(\d{2}/\d{2}/\d{2})"), "dd/MM/yy")


def dated_text(c: Column, as_of: Column) -> Column:
    """First date phrase of a page text: release label, then 'D[ - D] Month YYYY', then 'D Month' + current year.

    Within a form the month that comes first in the calendar wins, then the earlier place in the text.
    """
    any_month = "|".join(MONTHS)
    order = F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS) for x in (n, i)])

    def best(pattern: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        keyed = F.transform(
            found,
            lambda t, i: F.struct(
                order[F.regexp_extract(t, f"({any_month})", 1)].alias("month"), i.alias("at"), t.alias("text")
            ),
        )
        return F.array_min(keyed)["text"]

    bare = best(rf"(\d{{1,2}}\s+(?:{any_month}))(?!\s+\d{{4}})")
    return F.trim(F.coalesce(
        best(rf"Vizyon Tarihi\s*([0-9]{{1,2}}\s+(?:{any_month})\s+[0-9]{{4}})"),
        best(rf"(\d{{1,2}}(?:\s*-\s*\d{{1,2}})?\s+(?:{any_month})\s+\d{{4}})"),
        F.concat(bare, F.lit(" "), F.year(as_of).cast("string")),
    ))


def fill_date(listed: Column, title: Column, as_of: Column) -> Column:
    """The listed date, or the one in the title when the listing has none."""
    return F.coalesce(F.nullif(F.trim(listed), F.lit("")), F.nullif(date_from_title(title, as_of), F.lit("")))


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def from_iso(c: Column) -> Column:
    return F.try_to_timestamp(c)
