"""The registered queries against their SQL, brute force, held-out labels or exact properties."""

import hashlib
import html
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairground.llm import html_text, language, mixing, near_dedup, pii, registry, sharding, tokens
from tests.oracle import compare, connect

registry.load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_against_sql(spark, duck, key):
    assert compare(spark, duck, SF, key, registry.QUERIES[key], registry.ORACLES[key])[0] == "ok"


def rows(spark, key):
    return sorted((r.asDict() for r in registry.QUERIES[key](spark, SF).collect()), key=lambda r: r.get("doc_id", r.get("page_id")))


def test_word_hashes_depend_on_the_word_alone():
    texts = [b"alpha beta  alpha", b"", b"beta", b"x" * (tokens.PIECE * 2 + 5), b"y alpha", b"x" * (tokens.PIECE * 2 + 5)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, doc = tokens.words(data, offsets)
    got = [(d, bytes(data[s:e]), int(h)) for d, s, e, h in zip(doc, starts, ends, tokens.hashes(data, starts, ends))]
    assert [(d, w) for d, w, _ in got] == [(i, w) for i, t in enumerate(texts) for w in t.split()]
    assert len({w for _, w, _ in got}) == len({h for _, _, h in got}) == len({(w, h) for _, w, h in got})


def test_page_texts(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows(spark, "op4_html_text"):
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S).group(1)
        parts = re.split(r"</?(?:p|h1|li|ul|ol|div)\b[^>]*>", re.sub(r"<[^>]*\Z", "", body))
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in parts]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_blocks_by_structure():
    page = """<div class="page has-sidebar"><div id="sidebar"><p>side<p>side2</div><header>H</header>
<article><header class="entry-header"><h1>T &amp; t</h1></header><p>a <b>b</b>c<br>d<p>e<span class="ad">AD</span>f
<ul><li>x<li>y</ul><div class="user-comments"><article>c1</article></div></article><form>q</form><footer>f</footer></div>
<p hidden>no<p>z <a"""
    got = html_text.blocks(page)
    assert [t for z, t in got if z == html_text.ARTICLE] == ["T & t", "a bc d", "ef", "x", "y"]
    assert [t for z, t in got if z == html_text.ELSEWHERE] == ["z"]
    assert [t for z, t in got if z == html_text.CHROME] == ["side", "side2", "H", "c1", "q", "f", "no"]
    deep = "<div><b>" * 20_000 + "x" + "</i>" * 20_000 + "<p>y" * 20_000
    assert len(html_text.blocks(deep)) == 20_001


def test_head_without_end_tag():
    for rest in ("<body><p>a<p>b", "<p>a<p>b", "a<p>b", "<noscript><img></noscript><body class=x>a<p>b", "</head><body>a<p>b"):
        got = html_text.blocks(f"<html><head><meta charset=utf-8><title>T</title><style>s</style>{rest}")
        assert [t for z, t in got if z == html_text.ELSEWHERE] == ["a", "b"], rest
        assert {t for z, t in got if z == html_text.CHROME} == {"T", "s"}
    assert html_text.blocks("<head><title>T</title><body><article><p>x</article>")[-1] == (html_text.ARTICLE, "x")


def test_runs_match_brute_force():
    rng = np.random.default_rng(5)
    word, page = rng.integers(0, 3, 400), np.repeat(np.arange(8), 50)
    for run in (2, 5, 6, 8):
        at, rank = html_text.sorted_runs(word.astype(np.uint64), page, run)
        brute = {i: tuple(word[i : i + run]) for i in range(400 - run + 1) if page[i] == page[i + run - 1]}
        assert at.tolist() == list(brute)
        assert len({(brute[i], k) for i, k in zip(at.tolist(), rank.tolist())}) == len(set(brute.values())) == len(set(rank.tolist()))


def test_host_repeats_outside_articles_go():
    zone = np.array([html_text.ELSEWHERE] * 3)
    pages = [(zone, ["all rights reserved by the owner of this site", f"own words {i} of page number {i} here", "read more about us and our many partners"]) for i in range(5)]
    assert html_text.unique_text(pages) == [f"own words {i} of page number {i} here" for i in range(5)]
    inside = [(np.array([html_text.ARTICLE] * 2), ["the same copied article text on a few pages", f"tail {i}"]) for i in range(5)]
    assert html_text.unique_text(inside)[0] == "the same copied article text on a few pages\n\ntail 0"


def _page(own, *shared):
    return "".join(f"<p>{x}" for x in (*shared, own))


def _texts(spark, rows):
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}


def test_repeats_are_counted_over_the_whole_host(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(1500)]
    three = "one passage that three pages of this host share"
    most = "one passage that is in most articles of this host"
    rows = [_page(o, *[three] * (i in (5, 700, 1400))) for i, o in enumerate(own)]
    assert _texts(spark, rows) == dict(enumerate(own))
    two = [_page(o, *[three] * (i in (5, 700))) for i, o in enumerate(own)]
    assert _texts(spark, two) == {i: f"{three}\n\n{o}" if i in (5, 700) else o for i, o in enumerate(own)}
    long = [f"{o} " * 3 for o in own]
    for share, gone in ((750, True), (749, False)):  # of 1500 contents
        rows = [f"<article>{_page(o, *[most] * (i < share))}</article>" for i, o in enumerate(long)]
        assert _texts(spark, rows) == {i: f"{most}\n\n{o.strip()}" if i < share and not gone else o.strip() for i, o in enumerate(long)}


def test_copies_keep_their_text(spark):
    text = ["a whole page that its owner put on the host again", "and a second part of it with other words"]
    near = [" ".join(f"n{i}x{j}" for j in range(8)) for i in range(12)]
    menu = "home news sports weather about us and our partners"
    other = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(4)]
    bare = [_page(text[1], menu, text[0])] * 3 + [_page(o, menu) for o in other]
    assert list(_texts(spark, bare).values()) == ["\n\n".join(text)] * 3 + other
    assert set(_texts(spark, [_page(text[1], text[0])] * 3).values()) == {"\n\n".join(text)}
    article = [f"<article>{_page(text[1], text[0])}</article>"] * 12
    assert set(_texts(spark, article).values()) == {"\n\n".join(text)}
    assert set(_texts(spark, [f"<p>{n}{a}" for n, a in zip(near, article)]).values()) == {"\n\n".join(text)}
    alike = [f"<article>{_page(n, *text)}</article>" for n in near]
    assert _texts(spark, alike) == {i: "\n\n".join([*text, n]) for i, n in enumerate(near)}
    many = _texts(spark, [_page(text[1], menu, text[0])] * 600 + [_page(o, menu) for o in other])  # copies in several groups
    assert {many[i] for i in range(600)} == {"\n\n".join(text)} and [many[600 + i] for i in range(4)] == other


def test_personal_data_base(spark):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def valid(kind, s):
        digits = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    def brute(text):
        return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, text) if valid(k, m.group()))

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows(spark, "op6_pii"):
        spans = brute(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) - {""} <= set(r["spans"].split(","))
        assert sum(r[f"n_{k}"] for k in patterns) == spans.count(":") // 2
    rng = np.random.default_rng(3)
    for _ in range(3000):  # pieces that meet in awkward ways
        text = "".join(rng.choice(list("a1.@+-_ (9%") + ["12.3", "a@b.c", "+49 30 1234567", "4111 1111 1111 1111", "255", "é"], rng.integers(1, 14)))
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(pii.base_spans(text))) == brute(text), text


def test_reliable_labelers_win():
    rng = np.random.default_rng(8)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth) * 2 for right in (0.95, 0.9, 0.8)], axis=1)
    patterns, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = pii.reliabilities(np.zeros(len(patterns), int), patterns, n)
    assert ((p[where.ravel()] > 0.5) == truth).mean() > 0.94


def test_language_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = docs.withColumn("known", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = language.identify(seen, label="known", host=F.col("source")).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1")
    right, n = got.agg(F.sum(F.expr("int(language = lang)")), F.count("*")).first()
    assert right >= 0.98 * n
    noise = spark.createDataFrame([(i, "".join(np.random.default_rng(i).choice(list("qxzjkvw"), 200))) for i in range(20)], "doc_id long, text string")
    mixed = docs.select("doc_id", "text", "lang", "source").unionByName(noise.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"), allowMissingColumns=True)
    assert language.identify(mixed, host=F.col("source")).where("kept AND doc_id >= 1000000").count() == 0


def test_lookup_table():
    shards = tuple(f"s{i}" for i in range(7))
    table = sharding.lookup_table(shards, 499)
    # brute force: whole preference lists, one claim per turn
    prefs = [[(sharding._number(s, "offset") + j * (sharding._number(s, "skip") % 498 + 1)) % 499 for j in range(499)] for s in shards]
    taken: dict[int, int] = {}
    while len(taken) < 499:
        for i, p in enumerate(prefs):
            if len(taken) < 499:
                taken[next(x for x in p if x not in taken)] = i
    assert table == [taken[i] for i in range(499)]
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 499)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 499
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 500)


def test_shards_of_documents(spark):
    got = rows(spark, "op8_sharding")
    assert [r["doc_id"] for r in got] == list(range(len(got)))
    table = sharding.lookup_table()
    assert all(r["shard"] == sharding.SHARDS[table[r["slot"]]] for r in got)


def test_mixing_meets_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    fn = registry.QUERIES["op9_mixing"]
    got = {r["doc_id"]: r for r in fn(spark, sf).collect()}
    assert got == {r["doc_id"]: r for r in fn(spark, sf).collect()}  # reruns agree
    docs = duckdb.sql(f"SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM '{sf}/documents.parquet'").fetchall()
    size = Counter()
    for _, s, n in docs:
        size[s] += n
    # water filling by brute force
    open_, target, left = sorted(size), {}, sum(size.values())
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    while True:
        w = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / w > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: left * weight[s] / w for s in open_}
    taken = Counter()
    for d, s, n in docs:
        r = got[d]
        assert (r["size"], r["source_size"]) == (n, size[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, n, 2 * n, 3 * n)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in size)


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 100), ("", 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, weights=(5, 1, 9)).collect()}
    # order "", a, b, c, null with weights 5, 1, 9, 5, 1: "", c stop at 3 times their size, then a and null
    assert got[""] == 15 and got["c"] == 3 and got["a"] == 30
    assert got["b"] + got[None] == pytest.approx(1116 - 48) and got["b"] == pytest.approx(9 * got[None])


def test_pivot_keeps_the_words():
    rng = np.random.default_rng(1)
    sizes, total = rng.integers(1, 500, 300).astype(float), np.zeros(300)
    for _ in range(400):
        p, held = mixing._pivot(sizes, np.full(300, 0.3), rng.random(300))
        done = np.delete(p, held) if held >= 0 else p
        assert set(np.unique(done)) <= {0.0, 1.0} and (p * sizes).sum() == pytest.approx(0.3 * sizes.sum())
        total += p
    assert abs((total / 400).mean() - 0.3) < 0.01 and (total / 400).std() < 0.05  # no document is favoured


def test_near_groups_of_chains(spark):
    """Chains and hot groups in which most pairs are no links, against all pairs; several blocks to a cluster."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    texts = []
    for g in range(6):
        words = list(base) if g % 2 else [f"g{g}w{i}" for i in range(90)]
        for _ in range(60):
            for i in rng.integers(0, len(words), rng.integers(0, 4)):
                words[i] = f"e{rng.integers(10**9)}"
            texts.append(" ".join(words))
    near_dedup_block, near_dedup.BLOCK = near_dedup.BLOCK, 16
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect()}
    finally:
        near_dedup.BLOCK = near_dedup_block
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    up = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and up[i] != up[j]:
                lo, hi = sorted((up[i], up[j]))
                up = [lo if x == hi else x for x in up]
    assert [got[i] for i in range(len(texts))] == up


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's decisions, recomputed by brute force on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = {}
    for name, stage in stages.items():
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    text = {r["doc_id"]: r["text"] for r in kept["language_id"]}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in text.items() if (w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t)))}
    up = {d: d for d in text}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if up[a] != up[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = {d: lo if c == hi else c for d, c in up.items()}
    assert sorted(r["doc_id"] for r in kept["near_dedup"]) == sorted(d for d in up if up[d] == d)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t))
    grams = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r["text"])] for i in range(max(1, len(w) - 9))}
    clean = [r["doc_id"] for r in kept["near_dedup"] if not any(tuple(w[i : i + 10]) in grams for w in [words(r["text"])] for i in range(len(w)))]
    assert sorted(r["doc_id"] for r in kept["decontamination"]) == sorted(clean)
    times = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(times) <= set(clean) and max(times.values()) <= 3
    assert [r["doc_id"] for r in sorted(kept["sharding"])] == [r["doc_id"] for r in sorted(kept["mixing"])]
    table = sharding.lookup_table()
    assert all(r["shard"] == sharding.SHARDS[table[r["slot"]]] for r in kept["sharding"])
    assert corpus_pipeline.run(spark, SF).count() == len(kept["sharding"])
