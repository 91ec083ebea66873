"""Host verdicts and fused evidence recomputed plainly, on data where the methods decide."""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairground.llm import host_quality, language

GOOD = "plain sentence number {} tells about rivers hills towns bridges and weather"
SYMBOLS = "row {} ######## ******** |||||||| a b c d e f g h"


def test_a_bad_host_goes_and_an_unlucky_one_stays(spark):
    """60 good hosts, one where most texts fail a rule, one with a single text that fails, one without a name."""
    rows = [(f"good{h}", (SYMBOLS if h % 10 == 0 and i == 0 else GOOD).format(100 * h + i)) for h in range(60) for i in range(20)]
    rows += [("bad", (SYMBOLS if i < 36 else GOOD).format(i)) for i in range(40)]
    rows += [("unlucky", SYMBOLS.format(1)), (None, GOOD.format(1)), (None, SYMBOLS.format(2)), (None, GOOD.format(3))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, text string")

    hosts = collections.defaultdict(list)
    for host, text in rows:
        hosts[host].append(sum(text.count(c) for c in "#*$%&|<>") > len(text.split()))
    n, k = np.array([len(v) for v in hosts.values()]), np.array([sum(v) for v in hosts.values()])
    mean = k.sum() / n.sum()
    spread = max((k / n).var(ddof=1) - mean * (1 - mean) * (1 / n).mean(), 1e-9)
    precision = min(max(mean * (1 - mean) / spread - 1, 2.0), 1e4)
    rate = dict(zip(hosts, (k + mean * precision) / (n + precision)))

    got = {r["host"]: r for r in host_quality.host_verdicts(host_quality.measures(docs)).collect()}
    assert set(got) == set(hosts)
    assert all(got[h]["rate_symbols"] == pytest.approx(rate[h], rel=1e-9) for h in hosts)
    assert {h for h in got if got[h]["condemned"]} == {"bad"}
    judged = {r["doc_id"]: r for r in host_quality.judge(docs).collect()}
    assert not any(r["base_failed"] for r in judged.values())  # each verdict is the method's
    assert all(judged[i]["kept"] == (host != "bad") for i, (host, _) in enumerate(rows))


def softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pages_and_texts(spark):
    """Pages of many hosts under several suffixes, whose markup declares a language, a wrong one, an unknown one or none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    suffix = {"en": "uk", "de": "de", "fr": "fr", "es": "es"}
    pages, texts = [], []
    for r in docs:
        i = r["doc_id"]
        text = r["text"] if i % 9 else " ".join(r["text"].split()[:2])  # too short to tell by itself
        end = "com" if i % 4 == 0 else suffix.get(r["lang"], "org")
        url = None if i % 37 == 0 else f"https://site{i % 11}.example.{end}/{i}"
        tag = {0: "", 1: "lang='xx'", 2: 'lang="EN"'}.get(i % 12, f'lang="{r["lang"]}-1"')
        pages.append((i, url, f"<html {tag}><body>" if i % 41 else None))
        texts.append((i, text if i % 43 else None))
    return spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(texts, "page_id long, text string")


def test_fused_evidence(spark):
    """Text, markup, host and suffix of pages, fused by numpy from the same text likelihoods."""
    pages, texts = pages_and_texts(spark)
    got = {r["page_id"]: r for r in language.identify_pages(pages, texts).collect()}
    url = {r["page_id"]: r["url"] or "" for r in pages.collect()}
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    rows = sorted((r["page_id"], r["text"] or "") for r in texts.collect())

    def tag(i):
        value = html[i].partition("lang=")[2].strip("'\"").split(">")[0].split("-")[0].strip("'\"").lower()
        return value or None

    declared = [tag(i) for i, _ in rows]
    # a page without html or address has no declaration, host or suffix
    parts = [url[i].split("/")[2] if url[i] else "" for i, _ in rows]
    hosts = [h if url[i] else None for (i, _), h in zip(rows, parts)]
    ends = [h.rsplit(".", 1)[1] if h else None for h in parts]
    labelled = spark.createDataFrame([(i, t, d) for (i, t), d in zip(rows, declared)], "page_id long, text string, declared string")
    names, model = language.fit_text_model(labelled, "page_id", "text", "declared")
    assert len(names) >= 4
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["key", "text"])
    scored = pa.Table.from_batches(list(language._score(model)(iter([batch]))))
    logs, grams = np.array(scored["logs"].to_pylist()), np.array(scored["n_grams"])

    classes, values = [*names, language.UND], [*names, "?", "-"]
    size, read = len(classes), grams > 0
    posterior = softmax(logs) * read[:, None]
    said = ["-" if d is None else d if d in names else "?" for d in declared]

    def total(keys):
        sums = collections.defaultdict(lambda: np.zeros(size))
        for key, p in zip(keys, posterior):
            sums[key] += p
        return sums

    world = (posterior.sum(axis=0) + 1) / (posterior.sum() + size)
    trust = np.ones((size, size + 1)) / 2
    for value, p in total(said).items():
        trust[:, values.index(value)] += p
    trust /= trust.sum(axis=1, keepdims=True)
    smooth = lambda c, above: (c + language.SMOOTHING * above) / (c.sum() + language.SMOOTHING)
    of_suffix = {e: smooth(c, world) for e, c in total(ends).items()}
    of_host = {(h, e): smooth(c, of_suffix[e]) for (h, e), c in total(zip(hosts, ends)).items()}
    prior = np.array([of_host[x] for x in zip(hosts, ends)])
    p = softmax(logs + np.log(prior) + np.log([trust[:, values.index(v)] for v in said]))

    for j, (i, _) in enumerate(rows):
        best = classes[int(p[j].argmax())] if read[j] else language.UND
        sure = best != language.UND and p[j].max() >= language.LEAST
        kept_as_said = not sure and said[j] == "?" and read[j]
        want = (declared[j] if kept_as_said else best, bool(sure or kept_as_said))
        assert (got[i]["language"], got[i]["kept"]) == want, i
        assert got[i]["probability"] == pytest.approx(p[j].max() if read[j] else 1.0, rel=1e-6), i
    # the evidence beside the text changes what is decided
    alone = [classes[int(x.argmax())] for x in logs]
    assert any(read[j] and alone[j] != got[i]["language"] for j, (i, _) in enumerate(rows))
    assert language.identify_pages(pages.limit(0), texts.limit(0)).where(F.lit(True)).count() == 0
