"""Quality rules with verdicts on hosts.

Each text is measured once (words, symbols, repeated lines, repeated passages). Rules turn the measures into failures;
failures are counted by host, and each rule's rate at a host is shrunk towards what hosts usually have: a beta prior
is fitted to the hosts' rates by moments (precision from how far rates differ beyond chance), so a small host needs
more than a few bad pages to be condemned. A host that fails a rule at more than ``LIMIT`` is dropped with all its
documents; one document is dropped if it fails the base rule by itself.

Counts per host are combined map-side, so a host with a third of all documents is no hot group; the prior is a handful
of sums over hosts. Verdicts join back by host, where Spark may broadcast them by measured size or split a hot host.

Defined cases: a null text has no words (and fails the base rule); a null host is a host of its own; repeated rows
count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairground.llm import tokens
from fairground.llm.registry import query
from fairground.session import cut_lineage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
LIMIT = 0.5
RULES = {
    "base": "base_failed",
    "symbols": "n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
}
_SYMBOL = tokens.separators(b"#*$%&|<>")
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeats(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which (owner, x) occur more than once."""
    order = np.lexsort((x, owner))
    same = (x[order][1:] == x[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _measure_group(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n_texts = len(offsets) - 1
    starts, ends, doc = tokens.words(data, offsets)
    out = np.zeros((len(MEASURES), n_texts), np.int64)
    out[0] = np.bincount(doc, minlength=n_texts)
    points = np.concatenate([[0], np.cumsum(_CODE_POINT[data])])
    out[1] = np.bincount(doc, weights=points[ends] - points[starts], minlength=n_texts).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out[2] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    # lines that hold a word; a word never crosses a line break
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks, breaks + 1]))  # a break is a piece of its own, without a word
    line = np.searchsorted(edges, starts, side="right") - 1
    with_word = np.unique(line)
    line_doc = np.searchsorted(offsets, edges[with_word], side="right") - 1
    if len(with_word):
        h = tokens.hashes(data, edges[with_word], edges[with_word + 1])
        order = np.lexsort((h, line_doc))
        again = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        out[3] = np.bincount(line_doc[order][1:][again], minlength=n_texts)
        out[5] = np.bincount(line_doc, minlength=n_texts)
    x, at = tokens.windows(tokens.hashes(data, starts, ends), doc, WINDOW)
    hit = at[_repeats(x, doc[at])]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, np.minimum(hit + WINDOW, len(starts)), -1)
    covered = np.cumsum(change[:-1]) > 0
    out[4] = np.bincount(doc[covered], minlength=n_texts)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.column(batch.column(batch.num_columns - 1))
        for i, j in tokens.groups(offsets):
            got = _measure_group(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            kept = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], *MEASURES]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(m) for m in got], names=names)


def measures(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``key, host`` and the measures of each row's text, with ``base_failed``."""
    rows = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(_measure, f"key {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``host, n_docs``, each rule's shrunk rate, and ``condemned``."""
    counts = measured.groupBy("host").agg(
        F.count("*").alias("n_docs"), *[F.sum(F.expr(f"int({rule})")).alias(f"n_{name}") for name, rule in RULES.items()]
    )
    counts = cut_lineage(counts)
    # moments over hosts: the mean rate, the spread of rates, and the spread that chance alone would give
    sums = [F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), F.avg(1 / F.col("n_docs")).alias("inverse")]
    for name in RULES:
        rate = F.col(f"n_{name}") / F.col("n_docs")
        sums += [F.sum(f"n_{name}").alias(f"s_{name}"), F.avg(rate).alias(f"a_{name}"), F.var_samp(rate).alias(f"v_{name}")]
    prior = counts.agg(*sums).first()
    columns, condemned = [], F.lit(False)
    for name in RULES:
        mean = (prior[f"s_{name}"] or 0) / (prior["docs"] or 1)
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        noise = mean * (1 - mean) * (prior["inverse"] or 0)
        spread = max((prior[f"v_{name}"] or 0) - noise, 1e-9)
        precision = min(max(mean * (1 - mean) / spread - 1, 2.0), 1e4)
        rate = (F.col(f"n_{name}") + mean * precision) / (F.col("n_docs") + precision)
        columns.append(rate.alias(f"rate_{name}"))
        condemned = condemned | (rate > limit)
    return counts.select("host", "n_docs", *columns, condemned.alias("condemned"))


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """Per row of ``docs``: key, the measures, base_failed, kept."""
    measured = cut_lineage(measures(docs, key, host, text))
    verdicts = host_verdicts(measured, limit).select(F.col("host").alias("h"), "condemned")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("h")))
    return joined.select(F.col("key").alias(key), *MEASURES[:-1], "base_failed", (~F.col("base_failed") & ~F.col("condemned")).alias("kept"))


@query("op5_host_quality", r"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM d WHERE len(w) >= 5),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS MATERIALIZED (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3]) AS rule, unnest([sum(base_failed::INT), sum((n_symbols > n_words)::INT), sum((2 * n_dup_lines > n_lines)::INT)]) AS k FROM f GROUP BY source),
m AS (SELECT rule, least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS mean, avg(1 / n) AS inv, coalesce(var_samp(k / n), 0) AS v FROM h GROUP BY rule),
q AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-9) - 1, 2.0), 1e4) AS p FROM m),
c AS (SELECT source, max((k + mean * p) / (n + p)) > 0.5 AS condemned FROM h JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT condemned AS kept
FROM f JOIN c ON f.source IS NOT DISTINCT FROM c.source""")  # fmt: skip
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, judged with its host."""
    return judge(spark.read.parquet(f"{sf}/documents.parquet"))
