"""Group spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, so many words share one reduced word and a reduced word's neighbourhood (one
symbol replaced, deleted or inserted) is small however many letters there are. Two words that differ by one edit have
reduced words that are equal or neighbours.

1. Words are counted, map-side first. The number of symbols follows the size of the vocabulary, so that reduced words
   of seven symbols are at least as many as words; it only changes the work, never a result.
2. Every distinct reduced word generates its neighbourhood as 64-bit hashes, made from hashes of prefixes and suffixes.
   A neighbour relation is generated at one end: the longer word deletes (the shorter one's insertion), the word with
   the greater symbol replaces; every neighbouring pair is still met exactly once.
3. The hashes join the hashes of existing reduced words; pairs of reduced words become pairs of words, which are
   verified on their own letters (edit distance of exactly one).

Shuffled are hashes (eight bytes a side) and candidate pairs, never texts. Pairs of a class of equal reduced words are
verified as the join produces them; a class does not grow with a word's frequency, only with distinct spellings.

Defined cases: null and empty texts have no words, a null document id counts as empty text in the draw; repeated rows
count each; ties for the form go to the smallest word in code point order; a word without near words has none and is its
own root; words may have any length; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairground.llm.crc import CRC_TABLE, crc32_sql
from fairground.llm.registry import query
from fairground.llm.rows import named
from fairground.llm.tokens import mix
from fairground.session import cut_lineage

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FULL_LENGTH = 7  # reduced words of this length outnumber the vocabulary
LEAST_SYMBOLS, MOST_SYMBOLS = 4, 32
SYMBOLS = "".join(map(chr, range(65, 65 + MOST_SYMBOLS)))
PIECE = 1 << 20  # neighbours made at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)


def symbols_for(n_words: int) -> int:
    return min(MOST_SYMBOLS, max(LEAST_SYMBOLS, math.ceil(n_words ** (1 / FULL_LENGTH) - 1e-9)))


def reduced(word: Column, n_symbols: int) -> Column:
    """The word with each letter hashed to one of ``n_symbols``; other characters are hashed by class as well."""
    spread = mix(np.arange(1, len(LETTERS) + 1, dtype=np.uint64)) % np.uint64(n_symbols)
    return F.translate(word, LETTERS, "".join(SYMBOLS[i] for i in spread))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]), dtype=np.uint64)


def _by_length(array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in the array and a matrix of symbols (0 to n - 1), for each length that occurs."""
    texts = np.array(array.to_pylist(), dtype=object)
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = np.frombuffer("".join(texts[at]).encode("utf-32-le"), np.uint32)
        yield at, flat.reshape(len(at), n).astype(np.uint64) - np.uint64(64)


def _prefixes(symbols: np.ndarray) -> np.ndarray:
    """Hashes of the first 0 to n symbols: sums of symbol times power, the last symbol with power 0."""
    out = np.zeros((symbols.shape[0], symbols.shape[1] + 1), np.uint64)
    for i in range(symbols.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + symbols[:, i]
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word, count, reduced word and its hash."""
    for batch in batches:
        h = np.zeros(batch.num_rows, np.uint64)
        for at, symbols in _by_length(batch.column(2)):
            h[at] = mix(_prefixes(symbols)[:, -1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=["word", "n", "r", "h"])


def _neighbours(n_symbols: int):
    def part(symbols: np.ndarray, prefix: np.ndarray, power: np.ndarray, places: range) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and hashes for edits at some places."""
        rows, n = symbols.shape
        whole = prefix[:, -1]
        who, found = [np.arange(rows)], [mix(whole)]
        for i in places:
            tail = whole - prefix[:, i + 1] * power[n - i - 1]  # the hash of what follows
            who.append(np.arange(rows)), found.append(mix(prefix[:, i] * power[n - i - 1] + tail))
            for s in range(1, n_symbols):
                greater = np.flatnonzero(symbols[:, i] > s)
                changed = whole[greater] - (symbols[greater, i] - np.uint64(s)) * power[n - i - 1]
                who.append(greater), found.append(mix(changed))
        pair = np.unique(np.stack([np.concatenate(who).astype(np.uint64), np.concatenate(found)], 1), axis=0)
        return pair[:, 0].astype(np.int64), np.ascontiguousarray(pair[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(own hash, neighbour's hash): the word itself, each deletion, each replacement by a smaller symbol."""
        for batch in batches:
            own = batch.column(1).to_numpy(zero_copy_only=False)
            for at, symbols in _by_length(batch.column(0)):
                n = symbols.shape[1]
                rows = max(1, PIECE // (n * n_symbols))
                places = max(1, PIECE // (rows * n_symbols))
                for r in range(0, len(at), rows):
                    piece = symbols[r : r + rows]
                    prefix, power = _prefixes(piece), _powers(n)
                    for i in range(0, n, places):
                        who, found = part(piece, prefix, power, range(i, min(n, i + places)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[at[r : r + rows]][who]), pa.array(found.view(np.int64))], names=["own", "other"]
                        )

    return run


def near_pairs(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """``word, n, other, other_n`` for every ordered pair of distinct words one edit apart."""
    words = words.select(F.col(word).alias("word"), F.col(n).alias("n"))
    k = symbols_for(words.count())
    known = cut_lineage(words.withColumn("r", reduced(F.col("word"), k)).mapInArrow(_hashed, "word string, n long, r string, h long"))
    classes = known.select("r", "h").distinct()
    near = classes.mapInArrow(_neighbours(k), "own long, other long").join(
        classes.select(F.col("h").alias("other")).distinct(), "other"
    )
    left = known.select(F.col("h").alias("own"), F.col("word").alias("a"), F.col("n").alias("an"))
    right = known.select(F.col("h").alias("other"), F.col("word").alias("b"), F.col("n").alias("bn"))
    verified = near.join(left, "own").join(right, "other").where(
        ((F.col("own") != F.col("other")) | (F.col("a") < F.col("b")))
        & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    )
    # a pair comes twice only if two reduced words share a hash, or from two pieces of a very long word
    pair = verified.select(
        F.when(F.col("a") < F.col("b"), F.struct("a", "an", "b", "bn")).otherwise(
            F.struct(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn"))
        ).alias("p")
    ).distinct()
    ends = F.array(
        F.struct(F.col("p.a").alias("word"), F.col("p.an").alias("n"), F.col("p.b").alias("other"), F.col("p.bn").alias("other_n")),
        F.struct(F.col("p.b").alias("word"), F.col("p.bn").alias("n"), F.col("p.a").alias("other"), F.col("p.an").alias("other_n")),
    )
    return pair.select(F.inline(ends))


def group_variants(words: DataFrame, word: str = "word", n: str = "n", ratio: int = 2) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root.

    A form is at least ``ratio`` (2 or more) times as frequent as its word, so a chain of forms has at most 64 words and
    doubling the followed distance settles every root in six rounds.
    """
    words = cut_lineage(words.select(F.col(word).alias("word"), F.col(n).alias("n")))
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best")
    )
    kept = F.when(-F.col("best.m") >= F.lit(ratio) * F.col("n"), F.col("best"))
    named_forms = cut_lineage(
        words.join(near, "word", "left").withColumn("kept", kept).select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("kept.w").alias("form"), (-F.col("kept.m")).alias("form_n")
        )
    )
    steps = cut_lineage(named_forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return named_forms.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_n: int = 3, damage: int | None = None) -> DataFrame:
    """Lower-cased words of all texts with their number; ``damage`` deletes a letter from one in so many (document, word)s."""
    runs = F.explode(F.regexp_extract_all(F.translate(named(text), UPPER, LOWER), F.lit(f"({RUN})"), F.lit(1)))
    rows = docs.select(F.coalesce(named(key).cast("string"), F.lit("")).alias("k"), runs.alias("run"))
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat("k", F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return rows.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


@query("op12_spelling", f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
g AS (SELECT k, run, count(*) AS c FROM o GROUP BY k, run),
h AS (SELECT run, c, {crc32_sql("k || ':' || run")} AS h FROM g, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS MATERIALIZED (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS p FROM v)),
e AS (
  SELECT DISTINCT a.word, b.word AS other, a.n, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, a.n, b.n FROM x a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, b.n, a.n FROM x a JOIN v b ON a.rest = b.word),
f AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({{'m': -m, 'w': other}}) AS best FROM e GROUP BY word),
z AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
       CASE WHEN -best.m >= 2 * v.n THEN best.w END AS form, CASE WHEN -best.m >= 2 * v.n THEN -best.m END AS form_n
     FROM v LEFT JOIN f ON v.word = f.word),
t AS (SELECT word, word AS stop, 0 AS depth FROM z UNION ALL SELECT t.word, z.form, depth + 1 FROM t JOIN z ON t.stop = z.word WHERE z.form IS NOT NULL)
SELECT z.word, z.n, z.n_near, z.form, z.form_n::BIGINT AS form_n, r.stop AS root
FROM z JOIN (SELECT word, arg_max(stop, depth) AS stop FROM t GROUP BY word) r ON z.word = r.word""")  # fmt: skip
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling variants among all words of the documents, of which one in 97 lost a letter."""
    return group_variants(count_words(spark.read.parquet(f"{sf}/documents.parquet"), damage=97))
