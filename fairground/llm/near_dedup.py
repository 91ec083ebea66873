"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

A document's set is its distinct shingles. ``SAMPLES`` MinHash values are cut into bands for the candidate search; two
documents of similarity 0.8 miss each other in all bands with a probability of 3e-6, more similar ones far less. The
same samples are folded into an odd sketch: sample i toggles one of ``BITS`` bits, so samples that two documents share
cancel out in the XOR of their sketches, whose population count tells how many differ.

1. Documents with equal sets (128-bit digest and size) become one class, which gets a number of its own.
2. Classes that share a band are tied to the smallest number there (never to each other), and the ties' components are
   clusters: every link lies inside one.
3. Clusters are cut into blocks of ``BLOCK`` classes, and each pair of blocks is one small group. A task compares all
   sketches of its pair at once, skips pairs that the sketch rules out by six standard deviations and pairs already
   connected, and confirms the others on their full shingle sets. It returns a spanning forest of links, not pairs.
4. Components of the forests.

No group is collected whole: bands, digests and minima are combined map-side, a large cluster is many pairs of blocks.

Defined cases: null and empty texts, and texts without a word, have an empty set and link with nothing; a text of fewer
than ``n`` words is one shingle; in ``near_components``, rows that share a document id are one document with all their
sets, which ties these sets together, and a row without an id links nothing, has a null component and is kept; ids may
be of any type that has an order; the smallest id names a component; an empty table gives an empty result.
``drop_near_copies`` judges texts, see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairground.llm import tokens
from fairground.llm.components import components
from fairground.llm.registry import query
from fairground.llm.rows import keyed, named, same_row
from fairground.session import cut_lineage

SAMPLES, ROWS = 96, 4  # 24 bands
BITS = 512
BLOCK = 256
SIGMAS = 6.0
_RNG = np.random.default_rng(2024)
_A = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_SALT = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64)


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles and the start of each text's own (n_texts + 1); ASCII letters lower-cased, repeats included."""
    starts, ends, doc = tokens.words(data, offsets)
    h = tokens.hashes(tokens.LOWER[data], starts, ends)
    n_texts = len(offsets) - 1
    x, at = tokens.windows(h, doc, n)
    few, few_doc = tokens.short_windows(h, doc, n_texts, n)
    owner = np.concatenate([doc[at], few_doc])
    x = np.concatenate([x, few])
    order = np.argsort(owner, kind="stable")
    return x[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_texts))])


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.column(batch.column(1))
            for i, j in tokens.groups(offsets):
                part = data[offsets[i] : offsets[j]]
                x, first = _shingles(part, offsets[i : j + 1] - offsets[i], n)
                texts = j - i
                size, d1, d2 = np.zeros(texts, np.int64), np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
                for k in range(texts):
                    own = np.unique(x[first[k] : first[k + 1]])
                    size[k] = len(own)
                    d1[k] = tokens.mix(own ^ _SALT[0]).sum(dtype=np.uint64)
                    d2[k] = tokens.mix(own * _A[1] + _SALT[1]).sum(dtype=np.uint64)
                some = np.flatnonzero(size > 0)
                least = np.empty((len(some), SAMPLES), np.uint64)
                if len(some):
                    for s in range(SAMPLES):
                        least[:, s] = np.minimum.reduceat(x * _A[s] + _B[s], first[:-1][some])
                band = np.zeros((len(some), SAMPLES // ROWS), np.uint64)
                for r in range(ROWS):
                    band = tokens.mix(band + least[:, r::ROWS])
                band = tokens.mix(band ^ _SALT[: SAMPLES // ROWS])
                bit = (tokens.mix(least ^ _SALT) % np.uint64(BITS)).astype(np.int64)
                flat = np.bincount((np.arange(len(some))[:, None] * BITS + bit).ravel(), minlength=len(some) * BITS)
                sketch = np.packbits((flat & 1).astype(np.uint8).reshape(len(some), BITS), axis=1)
                bands, sketches = [None] * texts, [None] * texts
                for k, t in enumerate(some):
                    bands[t], sketches[t] = band[k].view(np.int64), sketch[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, texts), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["row", "n", "d1", "d2", "bands", "sketch"],
                )

    return run


def _ruled_out(similarity: float) -> int:
    """The greatest XOR population count that a link can have, but for one in 10^9."""
    slack = SIGMAS * np.sqrt(similarity * (1 - similarity) / SAMPLES)
    differ = 2 * SAMPLES * min(1.0, 1 - similarity + slack)
    expected = BITS / 2 * (1 - np.exp(-2 * differ / BITS))
    return int(np.ceil(expected + SIGMAS * np.sqrt(expected) / 4))


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _confirm(n: int, percent: int):
    most = _ruled_out(percent / 100)

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks: all pairs across it (inside it, if it is one block with itself)."""
        ids, side = pdf["id"].to_numpy(), pdf["side"].to_numpy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
        size = pdf["n"].to_numpy()
        lone = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = (np.arange(len(pdf)),) * 2 if lone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        found_a, found_b, found_z = [], [], []
        for a in left:
            others = right[right > a] if lone else right
            z = np.bitwise_count(sketch[others] ^ sketch[a]).sum(axis=1)
            fits = (z <= most) & (100 * np.minimum(size[others], size[a]) >= percent * np.maximum(size[others], size[a]))
            others = others[fits]
            found_a.append(np.full(len(others), a)), found_b.append(others), found_z.append(z[fits])
        a, b, z = map(np.concatenate, (found_a, found_b, found_z)) if found_a else (np.zeros(0, int),) * 3
        order = np.argsort(z, kind="stable")
        a, b = a[order], b[order]
        need = np.unique(np.concatenate([a, b]))
        sets: dict[int, np.ndarray] = {}
        data, offsets = tokens.column(pa.array(pdf["text"].iloc[need], pa.large_string()))
        for i, j in tokens.groups(offsets):
            x, first = _shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
            for k in range(j - i):
                sets[need[i + k]] = np.unique(x[first[k] : first[k + 1]])
        forest, out = _Forest(len(pdf)), []
        for p, q in zip(a.tolist(), b.tolist()):
            rp, rq = forest.root(p), forest.root(q)
            if rp == rq:
                continue
            s, t = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            both = int((t[at] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                forest.up[max(rp, rq)] = min(rp, rq)
                out.append((ids[p], ids[q]))
        return pd.DataFrame(out, columns=["a", "b"])

    return cell


def _signed(docs: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``id, t`` (a hash of the text), ``text``, and their sets' signatures, stored."""
    rows = docs.select(named(key).alias("id"), F.xxhash64(named(text)).alias("t"), F.coalesce(named(text), F.lit("")).alias("text"))
    schema = f"row struct<id: {dict(rows.dtypes)['id']}, t: long>, n long, d1 long, d2 long, bands array<long>, sketch binary"
    made = rows.select(F.struct("id", "t").alias("row"), "text").mapInArrow(_signatures(n), schema)
    return rows, cut_lineage(made.select("row.*", "n", "d1", "d2", "bands", "sketch"))


def _first(row: Column) -> Column:
    """The order in which documents give a group its name: by id, null last, then by text hash."""
    return F.struct(row.getField("id").isNull().alias("nameless"), row.getField("id").alias("id"), row.getField("t").alias("t"))


def _linked(rows: DataFrame, signed: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (``d1, d2, n, class, first``) and the links between classes (``a, b``), both stored."""
    classes = signed.where("n > 0").groupBy("d1", "d2", "n").agg(
        F.min(_first(F.struct("id", "t"))).alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = cut_lineage(cut_lineage(classes).withColumn("class", F.monotonically_increasing_id()))
    members = classes.select("class", F.explode("bands").alias("band"))
    least = members.groupBy("band").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most")
    ties = members.join(least, "band").where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()
    clusters = components(ties)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = clusters.join(sizes, "component").select(
        F.col("id").alias("class"), "component", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int").alias("block")
    )
    placed = cut_lineage(placed.join(classes.select("class", "first", "n", "sketch"), "class"))
    # a class's text: that of its first document, once
    mine = placed.select("class", "component", "blocks", "block", "n", "sketch", F.col("first.id").alias("f_id"), F.col("first.t").alias("f_t"))
    held = rows.join(mine, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("t") == F.col("f_t"))).dropDuplicates(["class"])
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"), (F.col("block") > o).cast("int").alias("side")))
    cells = held.select(F.col("class").alias("id"), "component", "n", "sketch", "text", F.explode(pair).alias("p")).select(
        "id", "component", "n", "sketch", "text", "p.i", "p.j", "p.side"
    )
    links = cut_lineage(cells.groupBy("component", "i", "j").applyInPandas(_confirm(n, percent), "a long, b long"))
    return classes.select("d1", "d2", "n", "class", "first"), links


def _grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes with the ``first`` document of their component."""
    found = components(links).select(F.col("id").alias("class"), "component")
    known = classes.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named_by = known.groupBy("component").agg(F.min("first").alias("of"))
    return known.join(named_by, "component").select("d1", "d2", "n", "of")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id, kept. Links: similarity of at least ``percent`` / 100."""
    rows, signed = _signed(docs, key, text, n)
    classes, links = _linked(rows, signed.where("id IS NOT NULL"), n, percent)
    # an id with several texts is one document: it ties their classes
    own = signed.where("n > 0 AND id IS NOT NULL").select("id", "d1", "d2", "n").join(classes.drop("first"), ["d1", "d2", "n"])
    several = own.groupBy("id").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most")
    same = own.join(several, "id").where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    found = _grouped(classes, links.unionByName(same))
    out = signed.select("id", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("of.id", "id"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of near copies, whole: the first by id, null last, then by a hash of its text.

    Texts are judged, not ids: unlike texts under one id all stay, equal texts without an id are copies. Rows without a
    word are nobody's copies; of repeated ones with an id, one stays.
    """
    rows, signed = _signed(docs, key, text, n)
    classes, links = _linked(rows, signed, n, percent)
    judged = signed.where("n > 0").select("id", "t", "d1", "d2", "n").join(_grouped(classes, links), ["d1", "d2", "n"])
    gone = judged.where(~(F.col("id").eqNullSafe(F.col("of.id")) & (F.col("t") == F.col("of.t"))))
    left = keyed(docs, key, text).join(gone.select(F.col("id").alias("v_k"), F.col("t").alias("v_t")).distinct(), same_row(), "left_anti")
    worded = F.coalesce(F.col("row").getField(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    single = left.where(F.col("k").isNotNull() | worded).dropDuplicates(["k", "t"])
    return single.select("row.*").unionByName(left.where(F.col("k").isNull() & ~worded).select("row.*"))


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query("op3_near_dedup", f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i:i + 3], ' ')))) END AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS c, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM c),
p AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT c AS c, c AS o FROM c UNION SELECT r.c, p.b FROM r JOIN p ON r.o = p.a),
m AS MATERIALIZED (SELECT c, min(o) AS m FROM r GROUP BY c)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON c.c = m.c""")  # fmt: skip
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components of all documents, on four-word shingles."""
    return near_components(spark.read.parquet(f"{sf}/documents.parquet"), n=4)
