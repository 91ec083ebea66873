"""Column functions on literal texts."""

import difflib

import pytest
from pyspark.sql import functions as F

from fairground.functions import dates, labels, places, prices, pvalues, replies, text
from fairground.functions.similarity import edit_ratio, seq_ratio, token_overlap


def col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def as_of(day="2026-01-07"):
    return F.lit(day).cast("timestamp")


RANGES = {
    "Aralık - 15": ["2026 Aralık 15"],
    "Aralık - 10 - 12": ["2026 Aralık 10", "2026 Aralık 11", "2026 Aralık 12"],
    "Aralık - 30 - 31 Ocak  - 02 - 03": ["2026 Aralık 30", "2026 Aralık 31", "2026 Ocak 02", "2026 Ocak 03"],
    "Ocak - 01 - 02": ["2026 Ocak 01", "2026 Ocak 02"],
    "28 Kasım": ["2026 Kasım 28"],
    "28 Şub": ["2026 Şubat 28"],
    "10 Aralık 2027": ["2027 Aralık 10"],
    "Aralık - 16 - 10": ["Aralık - 16 - 10"],
    "Some invalid date format": ["Some invalid date format"],
    "aralık - 15": ["aralık - 15"],
    "Aralık Ocak - 5": ["2026 Ocak 05"],
    "Aralık - x 5 Mart": ["2026 Mart 05"],
    "": [""],
    None: [None],
}


def test_date_ranges(spark):
    assert col(spark, RANGES, lambda c: dates.expand_dates(c, as_of(), strict=True)) == list(RANGES.values())


def test_every_month(spark):
    texts = [f"{m} - 15" for m in dates.MONTHS]
    assert col(spark, texts, lambda c: dates.expand_dates(c, as_of())) == [[f"2026 {m} 15"] for m in dates.MONTHS]


def test_leading_range(spark):
    c = ["10 - 12 Aralık 2025"]
    assert col(spark, c, lambda v: dates.expand_dates(v, as_of(), strict=True)) == [["2025 Aralık 12"]]
    assert col(spark, c, lambda v: dates.expand_dates(v, as_of())) == [[f"2025 Aralık {d}" for d in (10, 11, 12)]]


def test_year_rollover(spark):
    november = as_of("2025-11-20")
    assert col(spark, ["Ocak - 05", "Nisan - 05", "5 Ocak 2025"], lambda c: dates.expand_dates(c, november)) == [
        ["2026 Ocak 05"], ["2025 Nisan 05"], ["2025 Ocak 05"],
    ]


def test_impossible_day_is_null(spark):
    days = col(spark, ["Şubat - 31", "Şubat - 01"], lambda c: dates.expand_to_days(c, as_of()))
    assert days[0] == [None] and str(days[1][0]) == "2026-02-01"


def test_title_dates(spark):
    titles = {
        "5 Aralık Konseri": "2026 Aralık 05", "Konser 30 OCAK 2027": "2027 Ocak 30", "Gala Mart 7": "2026 Mart 07",
        "7 Mart ve 3 Ocak": "2026 Ocak 03", "12 ARALIK": "2026 Aralık 12", "no date": "", "": "", None: "",
    }
    assert col(spark, titles, lambda c: dates.date_from_title(c, as_of())) == list(titles.values())
    # Rolls over beside an explicit year too.
    assert col(spark, ["3 Ocak 2025"], lambda c: dates.date_from_title(c, as_of("2025-12-01"))) == ["2026 Ocak 03"]


def test_dashboard_dates(spark):
    texts = {
        "2026 Mayıs 23": "2026-05-23", "23 Mayıs 2025": "2025-05-23", "23 mayıs 19": "2026-05-23", "2025-12-15 20:00": "2025-12-15",
        "2025-12-15T20:00:00Z": "2025-12-15", "31 Şubat 2025": None, "Mayıs": None, "": None, None: None,
    }
    got = col(spark, texts, lambda c: F.date_format(dates.parse_date(c), "yyyy-MM-dd"))
    assert got == list(texts.values())


def test_page_dates(spark):
    texts = {
        "Vizyon Tarihi 28 Kasım 2025 Cuma": "28 Kasım 2025", "show 10 - 12 Mart 2026 x": "10 - 12 Mart 2026",
        "only 3 Mart here": "3 Mart 2026", "9 Ekim 2025 and 1 Ocak 2026": "1 Ocak 2026", "none": None,
    }
    assert col(spark, texts, lambda c: dates.dated_text(c, as_of())) == list(texts.values())


def test_week_key(spark):
    keys = col(spark, ["2024-01-01", "2023-01-01", "2024-12-31"], lambda c: dates.week_key(c.cast("timestamp")))
    assert keys == ["2024-W01", "2023-W00", "2024-W53"]


def test_slash_dates(spark):
    got = col(spark, ["Sal, 02/12/25 -", "Cum, 15/12/25", "x"], lambda c: dates.slash_date(c).cast("string"))
    assert got == ["2025-12-02", "2025-12-15", None]


def test_prices(spark):
    dot = {"150 TL": 150.0, "Free": 0.0, "Ücretsiz": 0.0, "1.500,00 TL": 1.5, "": None, None: None, "x": None, "12,5": 12.5}
    assert col(spark, dot, prices.parse_price) == list(dot.values())
    tr = {"₺1.200,00": 1200.0, "550,00 ₺": 550.0, "Satın Al": None, "12.345 TL": 12345.0}
    assert col(spark, tr, lambda c: prices.parse_price(c, "tr")) == list(tr.values())
    assert col(spark, ["a 150,00 TL b", "150 TL"], prices.price_in_text) == [150.0, None]


def test_ticket_json(spark):
    cases = {
        '{"prices": [{"name": "A", "price": "₺1.200,00"}, {"name": "B", "price": "900"}]}': 900.0,
        '{"1": {"satis_fiyati": "672,50"}, "2": {"price": 700}}': 672.5,
        '[{"fiyat": "50"}, {"tutar": "40,25"}]': 40.25,
        '{"1": "1.672,00", "2": 99}': 99.0,
        "{}": None,
        "broken": None,
        None: None,
    }
    assert col(spark, cases, prices.min_ticket_price) == list(cases.values())


def test_venues(spark):
    cases = {
        "Zorlu PSM, İstanbul": ("Zorlu PSM", "İstanbul"), "Ankara Arena": ("Ankara Arena", None),
        "CSO Ankara, Salon 2": ("CSO Ankara, Salon 2".rsplit(",", 1)[0], "Ankara"), "A, B, İzmir": ("A, B", "İzmir"),
    }
    assert [tuple(v) for v in col(spark, cases, places.split_venue)] == list(cases.values())


def test_ratings_and_urls(spark):
    assert col(spark, ['"4,7"', " 5 ", "x"], places.parse_rating) == [4.7, 5.0, None]
    assert col(spark, ["(1121 Yorum)", "1121"], places.parse_rating_count) == [1121, None]
    page = F.lit("https://site.example/a/b?x=1")
    urls = {"/c": "https://site.example/c", "c": "https://site.example/a/c", "//cdn.example/i": "https://cdn.example/i",
            "http://x.example/": "http://x.example/"}
    assert col(spark, urls, lambda c: places.absolute_url(c, page)) == list(urls.values())
    images = {"data:abc": None, "//x/i.jpg": "https://x/i.jpg", "/i.jpg": "https://s.example/i.jpg", "background: url('u.png')": "u.png"}
    assert col(spark, images, lambda c: places.image_url(c, "https://s.example")) == list(images.values())


def test_genres(spark):
    assert col(spark, ["Jazz", "STAND-UP", "Romantic", "Puppets", ""], places.filter_term) == ["Caz", "Stand up", None, "Puppets", None]


def test_text(spark):
    assert col(spark, [" a \t b\n", "", None], text.clean_text) == ["a b", "", ""]
    assert col(spark, [" a \t b\n", "", None], lambda c: text.clean_text(c, True)) == ["a b", None, None]
    assert col(spark, ["a" * 51, "b"], lambda c: text.truncate(c, 50)) == ["a" * 50 + "...", "b"]
    assert col(spark, ["No reviews available here", "good", None], text.is_boilerplate) == [True, False, False]


def test_lists(spark):
    cases = {
        '["a", "b"]': ["a", "b"], '{"uuids": ["a"]}': ["a"], '{"n": 1, "zzz": ["c"]}': ["c"], '{"n": 1}': None, "x": None,
        '{"zzz": ["c"], "winners": ["w"]}': ["w"],
    }
    assert col(spark, cases, replies.decode_list) == list(cases.values())


def test_people(spark):
    cases = {
        '[{"name": "A", "role": "WROTE"}]': [("A", "WROTE")], '{"name": "A", "role": "WROTE"}': [("A", "WROTE")],
        '{"people": [{"name": "A", "role": "CREW"}, {"role": "X"}]}': [("A", "CREW")], "x": [], None: [],
    }
    assert [[tuple(p) for p in v] for v in col(spark, cases, replies.decode_people)] == list(cases.values())


def test_replies(spark):
    cases = ['{"intent": "search", "confidence": 0.5}', '{"confidence": 0.5}', "x", "{}", None]
    got = col(spark, cases, lambda c: replies.decode_reply(c, "struct<intent: string, confidence: double>", ["intent"]))
    assert [None if g is None else g["intent"] for g in got] == ["search", None, None, None, None]


def test_similarity(spark):
    pairs = [("Jazz Night", "jazz nights"), ("abcd", "bcde"), ("", "x"), (None, "x"), ("private thread", "trivial read")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", seq_ratio("a", "b").alias("r"), edit_ratio(F.col("a"), F.col("b")).alias("e")).orderBy("i").collect()
    want = [difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0 for a, b in pairs]
    assert [r["r"] for r in got] == want
    assert got[1]["e"] == 0.5 and got[2]["e"] == 0.0
    assert col(spark, ["jazz night", ""], lambda c: token_overlap(c, F.lit("Jazz at the club"))) == [0.5, 0.0]


def test_labels(spark):
    got = col(spark, [0.9, -0.5, 0.31, 0.1], labels.correlation_strength, "double")
    assert got == ["Strong positive", "Moderate negative", "Weak positive", "Very weak positive"]
    assert col(spark, [9.0, 7.0, 2.0], labels.quality_band, "double") == ["high", "medium", "low"]


@pytest.mark.parametrize(
    ("f", "df1", "df2", "p"),
    [(4.256, 2, 9, 0.05), (3.478, 4, 10, 0.05), (161.4476, 1, 1, 0.05), (8.022, 2, 9, 0.01)],
)
def test_f_tail(f, df1, df2, p):
    assert pvalues.f_tail(f, df1, df2) == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize(("t", "df", "p"), [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (0.0, 5, 1.0)])
def test_t_tail(t, df, p):
    assert pvalues.t_two_sided(t, df) == pytest.approx(p, abs=3e-5)
