"""Language identification by Bayesian evidence fusion.

Evidence on a document: its text (a naive Bayes model on hashed byte trigrams of its letters), the language its markup
declares, and where it comes from. The prior of a host is its documents' mean text posterior, smoothed towards that of
its address suffix, which is smoothed towards that of the corpus; how far a declaration can be trusted is read from how
declarations and text posteriors go together. All of these are grouped sums over the whole corpus, combined map-side.
A long text's likelihood counts as that of ``FULL`` trigrams, as its trigrams aren't independent.

The class ``und`` has the same likelihood for every trigram. A document is rejected when it is the best class, when
no class reaches ``LEAST``, or when the text holds no letter. A document that declares a language without a class isn't
rejected for that: where it would be, the declaration (lower-cased) is its language, and it is kept.

The text model is fitted on labelled rows: at most about ``SAMPLE`` per language, chosen by key hash. Every label on
``ROWS`` rows gets a class (in a small table, on ``SHARE`` of the labelled rows), up to the ``CLASSES`` most frequent,
with ``BUCKETS`` numbers each; scoring takes time in proportion to their number. Everything else covers all rows.

Defined cases: a null or empty text, or one without letters, is ``und`` with probability 1 and rejected; a null
declaration is a value of its own, and so are all without a class together; ``und`` and blanks declare no language; a
null host or suffix is a value of its own; repeated rows count each; an empty table gives an empty result, and a table
without any label rejects everything. The probability of a language without a class is that of the best class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairground.llm import tokens
from fairground.llm.registry import query
from fairground.llm.rows import without
from fairground.session import cut_lineage

BUCKETS = 1 << 15
SAMPLE = 2000
ROWS = 30  # labelled rows that a language must have
SHARE = 0.005  # of the labelled rows, if that is less
CLASSES = 500
FULL = 100
SMOOTHING = 20.0
LEAST = 0.5
UND = "und"
# letters, lower-cased; all bytes beyond ASCII; 32 for anything else
_LETTER = np.full(256, 32, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every trigram of letters with at most one end beyond a word."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _LETTER[data]
    gap = x == 32
    use = ~gap[1:-1] & ~(gap[:-2] & gap[2:])
    # not across two texts
    for edge in (1, 2):
        cut = offsets[1:-1] - edge
        use[cut[(cut >= 0) & (cut < n - 2)]] = False
    at = np.flatnonzero(use)
    h = (x[at] * np.uint32(0x9E3779B1)) ^ (x[at + 1] * np.uint32(0x85EBCA6B)) ^ (x[at + 2] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array(batch.column(0).to_pylist(), dtype=object)
        data, offsets = tokens.column(batch.column(1))
        for i, j in tokens.groups(offsets):
            bucket, doc = _trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for label in set(labels[i:j]):
                mine = np.isin(doc, np.flatnonzero(labels[i:j] == label))
                counts[label] = counts.get(label, 0) + np.bincount(bucket[mine], minlength=BUCKETS)
    for label, c in counts.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))],
            names=["label", "bucket", "n"],
        )


def fit_text_model(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
                   sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (languages x BUCKETS), from a bounded sample of labelled rows."""
    labelled = docs.where(F.col(label).isNotNull() & (F.length(label) > 0))
    sizes = labelled.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = sizes.where((F.col("n") >= min(ROWS, SHARE * total)) & (F.lower(label) != UND)).orderBy(F.desc("n"), label)
    named = {r[0]: r[1] for r in frequent.limit(CLASSES).collect()}
    names = sorted(named)
    if not names:
        return [], np.zeros((0, BUCKETS), np.float32)
    spin = 1 << 20
    parts = [(name, int(min(1.0, sample / named[name]) * spin)) for name in names]
    rates = F.broadcast(docs.sparkSession.createDataFrame(parts, "label string, part int"))  # at most CLASSES rows
    rows = labelled.select(F.col(label).alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(spin)).alias("place"))
    rows = rows.join(rates, "label").where("place < part").select("label", "text")
    counts = rows.mapInArrow(_count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(names), BUCKETS), 0.5)
    got = counts.toArrow()
    row = {name: i for i, name in enumerate(names)}
    np.add.at(table, ([row[x] for x in got.column("label").to_pylist()], got.column("bucket").to_numpy()), got.column("n").to_numpy())
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(model: np.ndarray):
    flat = -np.log(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            data, offsets = tokens.column(batch.column(last))
            for i, j in tokens.groups(offsets):
                bucket, doc = _trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(doc, minlength=j - i)
                edges = np.concatenate([[0], np.cumsum(n)])
                logs = np.empty((j - i, len(model) + 1))
                for k, line in enumerate(model):
                    total = np.concatenate([[0.0], np.cumsum(line[bucket], dtype=np.float64)])
                    logs[:, k] = total[edges[1:]] - total[edges[:-1]]
                logs[:, -1] = n * flat
                logs *= (FULL / np.maximum(n, FULL))[:, None]
                logs -= logs.max(axis=1, keepdims=True)
                out = pa.FixedSizeListArray.from_arrays(pa.array(logs.ravel()), len(model) + 1).cast(pa.list_(pa.float64()))
                kept = [batch.column(c).slice(i, j - i) for c in range(last)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n.astype(np.int64)), out], names=[*batch.schema.names[:last], "n_grams", "logs"])

    return run


def _softmax(logs: Column) -> Column:
    # each step is a one-element transform, so that the step before is evaluated once: linear in the classes
    top = F.transform(F.array(logs), lambda x: F.struct(x.alias("l"), F.array_max(x).alias("m")))
    e = F.transform(top, lambda x: F.transform(x["l"], lambda y: F.exp(y - x["m"])))
    added = F.transform(e, lambda x: F.struct(x.alias("e"), F.aggregate(x, F.lit(0.0), lambda a, b: a + b).alias("t")))
    return F.get(F.transform(added, lambda x: F.transform(x["e"], lambda y: y / x["t"])), F.lit(0))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", declared: Column | None = None,
             host: Column | None = None, suffix: Column | None = None, least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: key, text_hash, language, probability, kept.

    ``label`` names the column the text model is fitted on; ``declared``, ``host`` and ``suffix`` are further evidence.
    """
    none = F.lit(None).cast("string")
    names, model = fit_text_model(docs, key, text, label)
    classes = [*names, UND]
    declared = none if declared is None else declared
    rows = docs.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"),
        # beyond the known languages a declaration is only "other"
        F.when(declared.isNull(), "-").when(F.lower(declared).isin(*names) if names else F.lit(False), F.lower(declared)).otherwise("?").alias("declared"),
        F.nullif(F.nullif(F.trim(F.lower(declared)), F.lit("")), F.lit(UND)).alias("said"),
        (none if host is None else host.cast("string")).alias("host"),
        (none if suffix is None else suffix.cast("string")).alias("suffix"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kind = dict(rows.dtypes)["key"]
    scored = cut_lineage(rows.mapInArrow(
        _score(model), f"key {kind}, text_hash long, declared string, said string, host string, suffix string, n_grams long, logs array<double>"
    ))
    size = len(classes)
    p = scored.where("n_grams > 0").withColumn("p", _softmax(F.col("logs")))
    # sums of posteriors by (host, suffix, declared): one shuffle of combined rows serves all levels
    sums = p.groupBy("host", "suffix", "declared").agg(*[F.sum(F.get("p", F.lit(c))).alias(f"c{c}") for c in range(size)])
    sums = cut_lineage(sums)
    added = [F.sum(f"c{c}").alias(f"c{c}") for c in range(size)]
    total = sums.agg(*added).first()
    world = np.array([total[c] or 0.0 for c in range(size)])
    world = (world + 1.0) / (world.sum() + size)
    trusted = np.ones((size, size + 1)) / 2  # true class x declared value (each class's name, "?" for und, and "-")
    values = [*names, "?", "-"]
    for r in sums.groupBy("declared").agg(*added).collect():  # at most one row per class and two
        trusted[:, values.index(r["declared"] if r["declared"] in values else "?")] += [r[f"c{c}"] or 0.0 for c in range(size)]
    trusted = np.log(trusted / trusted.sum(axis=1, keepdims=True))

    def smoothed(above: Column) -> Column:
        own = F.array(*[F.col(f"c{c}") for c in range(size)])
        # a one-element transform, so that the mass is added up once
        return F.get(F.transform(
            F.array(F.aggregate(own, F.lit(0.0), lambda a, b: a + b)),
            lambda mass: F.zip_with(own, above, lambda c, w: (c + SMOOTHING * w) / (mass + SMOOTHING)),
        ), F.lit(0))

    by_suffix = sums.groupBy("suffix").agg(*added).select(F.col("suffix").alias("s"), smoothed(F.array(*[F.lit(float(w)) for w in world])).alias("above"))
    by_host = sums.groupBy("host", "suffix").agg(*added).join(by_suffix, F.col("suffix").eqNullSafe(F.col("s")))
    by_host = by_host.select(
        F.col("host").alias("h"), F.col("suffix").alias("s"),
        smoothed(F.col("above")).alias("prior"),
    )
    trust = docs.sparkSession.createDataFrame([(value, trusted[:, v].tolist()) for v, value in enumerate(values)], "declared string, trust array<double>")
    joined = scored.join(by_host, F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("s")), "left")
    joined = joined.join(F.broadcast(trust), "declared")  # every declared value has its row
    prior = F.coalesce("prior", F.array(*[F.lit(float(w)) for w in world]))
    fused = F.zip_with(F.zip_with("logs", prior, lambda a, b: a + F.log(b)), F.col("trust"), lambda a, b: a + b)
    known = joined.withColumn("p", _softmax(fused)).withColumn("best", F.array_max("p"))
    listed = F.array(*map(F.lit, classes))
    name = F.when(F.col("n_grams") > 0, F.element_at(listed, F.array_position("p", F.col("best")).cast("int"))).otherwise(F.lit(UND))
    known = known.withColumn("found", name).withColumn("sure", (F.col("found") != UND) & (F.col("best") >= least))
    other = ~F.col("sure") & (F.col("declared") == "?") & F.col("said").isNotNull() & (F.col("n_grams") > 0) & F.lit(bool(names))
    return known.select(
        F.col("key").alias(key), "text_hash", F.when(other, F.col("said")).otherwise(F.col("found")).alias("language"),
        F.when(F.col("n_grams") > 0, F.col("best")).otherwise(F.lit(1.0)).alias("probability"),
        (F.col("sure") | other).alias("kept"),
    )


def identify_documents(docs: DataFrame) -> DataFrame:
    return identify(docs, declared=F.col("lang"), host=F.col("source"))


def identify_pages(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Languages of pages' extracted ``texts`` (page_id, text) with the evidence of their markup and address."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    evidence = pages.select("page_id", host.alias("host"), F.nullif(declared, F.lit("")).alias("declared"))
    rows = texts.select("page_id", "text").join(evidence, "page_id")
    suffix = F.nullif(F.regexp_extract("host", r"\.([a-z0-9-]+)$", 1), F.lit(""))
    return identify(rows, "page_id", label="declared", declared=F.col("declared"), host=F.col("host"), suffix=suffix)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that language identification does not reject, with the columns of ``docs``."""
    bad = identify_documents(docs).where("NOT kept").select(F.col(key).alias("v_k"), F.col("text_hash").alias("v_t")).distinct()
    return without(docs, bad, key, text)


@query("op7_language")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Language, probability and verdict of every document."""
    return identify_documents(spark.read.parquet(f"{sf}/documents.parquet")).drop("text_hash")
