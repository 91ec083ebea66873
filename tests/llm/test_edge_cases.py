"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairground.llm import (decontamination, host_quality, html_text, language, line_dedup, mixing, near_dedup, pii,
                            sharding, warc)

LONG = " ".join(f"w{i % 5000}x{i // 7}" for i in range(60_000))
BASE = "the quick brown fox jumps over the lazy dog while seven other foxes sleep under old trees near the river bank at night"
ROWS = [
    (1, BASE, "en", "a"),
    (1, BASE, "en", "a"),  # repeated row
    (2, BASE, "en", "a"),  # exact copy
    (3, BASE + " today", None, None),  # near copy
    (4, None, "en", "a"),
    (5, "", None, "b"),
    (6, LONG, "en", "b"),
    (7, "één\ttwee\ndrie", "nl", "b"),
    (None, "no identity here at all but some words to read", "en", "c"),
    (None, "no identity here at all but some words to read", "en", "c"),
    (8, "a\n\n\nb\r\n" * 40, "en", "c"),
]
# names that helpers use themselves
CLASH = ("k", "t", "row", "h", "n", "key", "size", "slot", "shard", "class", "host", "spans", "v_k", "body", "cut")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(10, "fox jumps over the lazy dog while seven other foxes sleep"), (11, "twee DRIE"), (12, None), (None, ""), (13, "twee drie")]
    return spark.createDataFrame(rows, "item_id long, text string")


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=repr)


def test_decontamination(docs, items):
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, items).collect() if r["doc_id"] is not None}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["n_words"]) == (11, 1, 23)
    assert (got[4]["n_words"], got[4]["n_hit"], got[5]["n_words"]) == (0, 0, 0)
    assert (got[7]["n_hit"], got[7]["n_items"], got[7]["contaminated"]) == (2, 2, True)
    assert got[6]["n_words"] == 60_000 and not got[6]["contaminated"]
    assert decontamination.contamination(docs, items).count() == len(ROWS)
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 6
    cut = decontamination.remove_spans(docs, items)
    texts = dict(by_id(cut.where("doc_id IS NOT NULL"), "text"))
    assert texts[1] == "the quick brown under old trees near the river bank at night" and texts[7] == "één\t" and texts[6] == LONG
    assert cut.where("row = 'own row' AND k = 'own k'").count() == len(ROWS)
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_decontamination_across_chunks(spark):
    text = " ".join(f"w{i}" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(2040, 2060))), (2, "w9999"), (3, "w0 w1 w2")], "item_id long, text string")
    for most in (decontamination.MAX_BROADCAST, 0):  # broadcast and shuffled
        row = decontamination.contamination(docs, items, most=most).first()
        assert (row["n_words"], row["n_hit"], row["n_items"]) == (10_000, 24, 3)


def test_line_dedup(docs, spark):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == len(ROWS) and "row" in out.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[4]["text"] is None and got[4]["n_lines"] == 0 and got[5]["text"] == "" and got[6]["text"] == LONG
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    shared = "\n".join(f"shared line number {i} of a long passage" for i in range(12))
    texts = [(i, "\n".join([f"{i} own {j}" for j in range(i + 2)]) + "\n" + shared + "\n" + "\n".join(f"{i} end {j}" for j in range(4))) for i in range(4)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[0]["text"] == texts[0][1] and got[0]["n_cut_lines"] == 0
    for i in (1, 2, 3):  # shifted by inserted lines, still cut; own lines stay
        assert got[i]["n_cut_lines"] >= 6 and f"{i} own 0" in got[i]["text"] and f"{i} end 3" in got[i]["text"]


def test_near_dedup(docs):
    out = near_dedup.near_components(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 4, 5, 6]
    assert (got[4]["n_shingles"], got[5]["n_shingles"], got[7]["n_shingles"], got[1]["n_shingles"]) == (0, 0, 1, 19)
    assert got[None]["component_id"] is None and got[None]["kept"]
    kept = near_dedup.drop_near_copies(docs)
    # the two equal texts without an id are copies of each other: one document of each group stays
    assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 5, 6, 7, 8]
    assert kept.columns == docs.columns
    assert near_dedup.near_components(docs.limit(0)).count() == 0


def test_html_text(spark):
    rows = [(1, "http://h.example/1", None), (2, None, "<p>one<p>two &amp; three"), (2, None, "<p>one<p>two &amp; three"),
            (3, "x", "<nav>menu</nav><article>A<br>b &nbsp; c</article><footer>f</footer>"), (4, "http://h.example/2", "<p cut"),
            (5, "http://h.example/3", "<article><p>" + "long " * 200_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "text", "part")})
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert got == {1: "", 2: "one\n\ntwo & three", 3: "A b c", 4: "", 5: ("long " * 200_000).strip()}
    assert html_text.main_text(pages).count() == 6 and html_text.main_text(pages.limit(0)).count() == 0


def test_host_quality(docs):
    got = {r["doc_id"]: r for r in host_quality.judge(docs).collect()}
    assert (got[4]["n_words"], got[4]["base_failed"], got[4]["kept"]) == (0, True, False)
    assert (got[1]["n_words"], got[1]["word_chars"], got[1]["base_failed"]) == (23, len(BASE.replace(" ", "")), False)
    assert (got[8]["n_words"], got[8]["n_dup_lines"], got[8]["n_repeat_words"]) == (80, 78, 80)
    assert got[7]["word_chars"] == 11
    assert host_quality.judge(docs).count() == len(ROWS) and host_quality.judge(docs.limit(0)).count() == 0


def test_pii(docs, spark):
    assert pii.find_personal_data(docs).where("size(spans) > 0").count() == 0
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    rows = [(1, "mail a.b@c.example and é +49 (30) 123-4567 or 10.0.0.1"), (2, None), (3, "9" * 200_000 + "." * 9 + "a" * 200_000 + "@")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0))
    got = {r["doc_id"]: r["s"] for r in pii.find_personal_data(texts).select("doc_id", pii.spelled("base").alias("s")).collect()}
    assert got == {1: "email:5:18,ip:46:54,phone:25:42", 2: "", 3: ""}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(texts).collect()}
    assert masked[1] == "mail [email] and é [phone] or [ip]" and masked[2] is None and masked[3] == rows[2][1]


def test_language(docs):
    out = language.identify_documents(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ROWS)
    assert not got[4]["kept"] and got[4]["language"] == "und" and not got[5]["kept"]
    assert got[1]["kept"] and got[1]["language"] == "en"
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (4, 5)").count() == 0
    assert language.identify_documents(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.identify_documents(unlabelled).where("kept").count() == 0


def test_rare_languages_stay(spark):
    rng = np.random.default_rng(4)
    letters = {"en": "abcdefghij", "nl": "ijklmnopqr", "el": "αβγδεζηθικλ", "ka": "აბგდევზთიკ"}
    of = ["ka"] * 3 + ["el"] * 40 + ["en"] * 20_000 + ["nl"] * 19_957  # el is 0.1 %
    texts = {lang: [" ".join("".join(rng.choice(list(a), 5)) for _ in range(30)) for _ in range(60)] for lang, a in letters.items()}
    rows = [(i, f"{texts[lang][i % 60]}", lang, "one") for i, lang in enumerate(of)]
    rows += [(10**6 + i, texts["el"][i], None, "one") for i in range(10)] + [(10**6 + 10, "12 34", "ka", "one"), (10**6 + 11, texts["ka"][9], "und", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language.identify_documents(docs).where("doc_id < 43 OR doc_id >= 1000000").collect()}
    assert [got[i]["language"] for i in range(43)] == of[:43] and all(got[i]["kept"] for i in range(43))
    assert all(got[10**6 + i]["language"] == "el" and got[10**6 + i]["kept"] for i in range(10))
    assert not got[10**6 + 10]["kept"] and not got[10**6 + 11]["kept"]


def test_sharding(docs):
    out = sharding.place(docs)
    assert out.count() == len(ROWS) and out.columns[-2:] == ["slot", "shard"]
    assert out.where("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.place(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.copies(docs)
    assert out.count() == len(ROWS)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[4]["size"] == 0 and got[4]["taken"] == 0 and got[3]["source_size"] == 24
    assert out.where("taken > 3 * size OR target > 3 * source_size").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("row <> 'own row'").count() == 0
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 300_000  # several segments, with what looks like records inside
    rows = [(1, "http://a", "x" * 100), (2, "http://b\r\nX: y", "x" * 100), (3, None, None), (None, "u", "x" * 100), (5, "u", "y"),
            (6, "u", "y"), (7, "u", big), (1, "http://a", "x" * 100), (8, "u", "\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    folder = str(tmp_path / "archive")
    warc.write_archives(pages, folder)
    chunks = warc.read_archives(spark, folder)
    last = chunks.where("last").collect()
    assert len(last) == len(rows) and all(r["digest_ok"] in (True, None) for r in last)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in last)
    assert kinds == [(0, "revisit", 1, 100), (1, "response", None, 100), (1, "response", None, 100), (2, "revisit", 1, 100),
                     (3, "response", None, 0), (5, "response", None, 1), (6, "response", None, 1),
                     (7, "response", None, len(big.encode())), (8, "response", None, 2)]
    parts = chunks.where("page_id = 7").orderBy("chunk_no").collect()
    assert max(len(r["data"]) for r in parts) <= warc.CHUNK and b"".join(r["data"] for r in parts) == big.encode()
    heads = [r.value for r in spark.read.option("lineSep", "\r\n").text(folder).collect() if r.value.startswith("WARC-")]
    dates = [h for h in heads if re.fullmatch(r"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h)]
    assert len(dates) == sum(h.startswith("WARC-Type: ") for h in heads) > 0  # every record has one
    warc.write_archives(pages.limit(3), str(tmp_path / "dated"), date=F.lit("2020-02-03 04:05:06").cast("timestamp"))
    assert spark.read.text(str(tmp_path / "dated")).where("value LIKE 'WARC-Date: 2020-02-03T04:05:06Z%'").count() == 3
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, items, tmp_path, name, stage):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        out = stage(spark, table, str(tmp_path))
        assert out.columns[: len(docs.columns) - 2] == [c for c in docs.columns if c not in ("slot", "shard")] or out.columns == docs.columns
        out.write.format("noop").mode("overwrite").save()


def test_near_copies_are_judged_by_text(spark):
    x, y, z = BASE, "entirely other words about rivers and stones that nobody else wrote down before", "a third text which has nothing in common with any of those above it"
    rows = [(3, x), (5, x), (5, y), (9, z), (None, z + " today"), (None, "free " + y[::-1]), (None, "free " + y[::-1]), (7, None), (7, None), (None, ""), (None, "")]
    kept = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), n=2)
    assert by_id(kept, "text") == sorted(
        [(3, x), (5, y), (9, z), (None, "free " + y[::-1]), (7, None), (None, ""), (None, "")], key=repr
    )
    # as documents, both texts of 5 are one
    parts = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), n=2)
    assert {r["component_id"] for r in parts.collect() if r["doc_id"] == 5} == {3}
    # ids may be text
    named = near_dedup.near_components(spark.createDataFrame([("b", x), ("a", x + " today"), ("c", y)], "doc_id string, text string"))
    assert by_id(named, "component_id", "kept") == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


@pytest.mark.parametrize("rate", [0.4, 0.67, 1.3])
def test_equal_rows_meet_their_target(spark, rate):
    """4,000 equal rows without an id, and unlike rows under one id, beside a source that takes the rest."""
    many = [(None, "four words in each", "a", i % 3) for i in range(4000)]
    other = round(16_000 * (3 - rate) / rate / 2) * 2 if rate < 1 else 16_000
    rows = spark.createDataFrame(many, "doc_id long, text string, source string, extra int")
    sizes = {"a": 16_000, "b": other}
    target = min(3 * 16_000, sum(sizes.values()) / 3)
    more = spark.range(other // 10).selectExpr("id AS doc_id", "'ten words are in this one here and some more' AS text", "'b' AS source", "0 AS extra")
    mixed = mixing.mix(rows.unionByName(more)).where("source = 'a'")
    assert abs(mixed.count() * 4 - target) <= 4
    taken = {r["extra"]: r["count"] for r in mixed.groupBy("extra").count().collect()}
    assert max(taken.values()) - min(taken.values()) <= 4
    per_row = mixing.copies(rows.unionByName(more)).where("source = 'a'")
    low, high, total, n = per_row.agg(F.min("n_copies"), F.max("n_copies"), F.sum("taken"), F.count("*")).first()
    assert high - low <= 1 and n == 4000 and total == mixed.count() * 4


def test_many_small_sources_share_groups(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    leaf = mixing._round_leaf

    def counted(seed):
        run = leaf(seed)

        def one(pdf):
            calls.add(1)
            return run(pdf)

        return one

    monkeypatch.setattr(mixing, "_round_leaf", counted)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 1500) AS source", "repeat('w ', int(id % 7)) AS text")
    out = mixing.copies(docs).collect()
    assert len(out) == 3000 and calls.value < 20
    taken = {}
    for r in out:
        taken.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 7 for t, n in taken.values())
