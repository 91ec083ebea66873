"""Benchmark decontamination: find benchmark n-grams in documents and remove the spans or the documents.

Words are runs of ASCII letters and digits and of any character beyond ASCII, with A-Z lower-cased. Every run of ``N``
consecutive words of an item is a window; an item with fewer words, but not none, is one window. The windows form a
hash set keyed by a 64-bit hash. Documents are cut into overlapping runs of words, so that a very long one is many
small rows; token windows around an anchor (one word of each benchmark window) are hashed and looked up, and a hit is
verified by comparing the words themselves.

The window set is broadcast only when it was counted and holds at most ``MAX_BROADCAST`` windows; beyond that, all
token windows are shuffled to meet it. Everything is DataFrame expressions. What is shuffled is hits, never texts.

Defined cases: a null or empty text has no words and no hits; a null item id counts as an item and sorts as the empty
string; repeated rows each get the verdict of their id and text; items repeated under several ids all count; empty
tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fairground.llm.registry import query
from fairground.llm.rows import keyed, same_row, without
from fairground.session import cut_lineage

N = 10
CHUNK = 2048  # words to a row
MAX_BROADCAST = 2_000_000  # windows; about 200 bytes each in the hash table
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The normalised words of a text; an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # ASCII alone: lower() changes just A-Z and is far cheaper
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """``gram, h, len, items, anchor, off``: each distinct window, its hash, its words, the ids of the items that hold it
    (as text), and the hash and place of its anchor, the word that is rarest among the items (then longest, then first).
    """
    rows = items.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    length = F.least(F.size("w"), F.lit(n))
    grams = rows.select("item", length.alias("len"), F.explode(
        F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.array_join(F.slice("w", i, length), " "))
    ).alias("gram"))
    grams = grams.groupBy("gram", "len").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items"))
    times = rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    placed = grams.select("gram", F.posexplode(F.split("gram", " ")).alias("off", "word")).join(times, "word")
    best = F.min(F.struct("times", (-F.length("word")).alias("size"), "off", "word")).alias("a")
    anchors = placed.groupBy("gram").agg(best).select("gram", "a.off", F.xxhash64("a.word").alias("anchor"))
    return grams.join(anchors, "gram").withColumn("h", F.xxhash64("gram"))


def scan(docs: DataFrame, windows: DataFrame, n: int = N, chunk: int = CHUNK, most: int = MAX_BROADCAST) -> DataFrame:
    """One pass over the texts of ``docs`` (``k, t, text``): ``k, t, n_words, at, len, gram``.

    A row for each verified hit (``at``: 0-based word), and one for each document with null ``at``. A word that is no
    window's anchor costs one lookup; only around anchors are windows put together, hashed and looked up.
    """
    words = docs.select("k", "t", words_of(F.col("text")).alias("w"))
    # an empty word stands before each chunk: in the first it carries the document's own row
    n_words = F.size("w")
    chunks = words.select("k", "t", n_words.alias("n_words"), F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(n_words, F.lit(1)) - 1) / chunk).cast("int")),
        lambda c: F.concat(F.array(F.lit("")), F.slice("w", c * chunk + 1, chunk + n - 1)),
    )).alias("c", "v"))
    at = (F.col("c") * chunk + F.col("s") - 1).alias("at")
    same = (F.col("h") == F.col("w_h")) & (F.col("gram") == F.col("w_gram"))
    if windows.count() <= most:
        keys = F.broadcast(windows.select(F.col("h").alias("w_h"), F.col("gram").alias("w_gram"), F.col("off").alias("w_off")))
        anchors = windows.select("anchor", "off", "len").distinct().union(docs.sparkSession.range(1).select(
            F.xxhash64(F.lit("")).alias("anchor"), F.lit(-1).alias("off"), F.lit(0).alias("len")
        ))
        rows = chunks.select("k", "t", "n_words", "c", "v", F.posexplode("v").alias("p", "x"))
        rows = rows.join(F.broadcast(anchors), F.xxhash64("x") == F.col("anchor")).withColumn("s", F.col("p") - F.col("off"))
        fits = (F.col("s") >= 1) & (F.col("s") <= chunk) & (F.col("s") + F.col("len") <= F.size("v"))
        rows = rows.where(((F.col("off") < 0) & (F.col("c") == 0)) | ((F.col("off") >= 0) & fits))
        gram = F.when(F.col("off") >= 0, F.array_join(F.slice("v", F.col("s") + 1, F.col("len")), " "))
        rows = rows.select("k", "t", "n_words", "off", at, "len", gram.alias("gram")).withColumn("h", F.xxhash64("gram"))
        rows = rows.join(keys, same & (F.col("off") == F.col("w_off")), "left").where("off < 0 OR w_gram IS NOT NULL")
        hit = F.col("off") >= 0
        return rows.select("k", "t", "n_words", F.when(hit, F.col("at")).alias("at"), F.when(hit, F.col("len")).alias("len"), "gram")
    # too many windows to broadcast: every window of the texts goes to meet them by hash
    lengths = [r[0] for r in windows.select("len").distinct().collect()]  # at most n values
    none = F.array().cast("array<struct<len:int,s:int,gram:string>>")

    def windows_of(k: int) -> Column:
        starts = F.least(F.lit(chunk), F.size("v") - k)
        gram = F.transform(F.sequence(F.lit(1), starts), lambda s: F.struct(
            F.lit(k).alias("len"), s.alias("s"), F.array_join(F.slice("v", s + 1, k), " ").alias("gram")))
        return F.when(F.size("v") > k, gram).otherwise(none)

    rows = chunks.select("k", "t", "n_words", "c", F.inline(F.concat(*[windows_of(k) for k in sorted(lengths)])))
    rows = rows.select("k", "t", "n_words", at, "len", "gram", F.xxhash64("gram").alias("h"))
    hits = rows.join(windows.select(F.col("h").alias("w_h"), F.col("gram").alias("w_gram")), same)
    no_int, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    own = words.select("k", "t", n_words.alias("n_words"), no_int.alias("at"), no_int.alias("len"), no_text.alias("gram"))
    return hits.select("k", "t", "n_words", "at", "len", "gram").unionByName(own)


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", n: int = N, most: int = MAX_BROADCAST) -> DataFrame:
    """Per row of ``docs``: key, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = benchmark_windows(items, item, item_text, n)
    found = cut_lineage(scan(_narrow(docs, key, text), windows, n, most=most))  # narrow rows, read three times below
    hits = found.where("at IS NOT NULL")
    # covered words, in order of position: what each hit adds to the furthest end so far
    spans = hits.groupBy("k", "t", "at").agg(F.max("len").alias("len"))
    so_far = Window.partitionBy("k", "t").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    added = F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(F.max(end).over(so_far), F.lit(0))))
    covered = spans.select("k", "t", added.alias("added")).groupBy("k", "t").agg(F.sum("added").alias("n_hit"))
    held = hits.select("k", "t", "gram").distinct().join(windows.select("gram", "items"), "gram")
    held = held.select("k", "t", F.explode("items").alias("item")).groupBy("k", "t").agg(F.sort_array(F.collect_set("item")).alias("items"))
    stats = covered.alias("a").join(held.alias("b"), F.expr("a.k <=> b.k AND a.t <=> b.t")).select(
        F.col("a.k").alias("s_k"), F.col("a.t").alias("s_t"), "n_hit", "items"
    )
    none = F.array().cast("array<string>")
    return found.where("at IS NULL").join(stats, F.expr("k <=> s_k AND t <=> s_t"), "left").select(
        F.col("k").alias(key), F.col("t").alias("text_hash"), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any hit, with the columns of ``docs``."""
    hits = scan(_narrow(docs, key, text), benchmark_windows(items)).where("at IS NOT NULL")
    bad = hits.select(F.col("k").alias("v_k"), F.col("t").alias("v_t")).distinct()
    return without(docs, bad, key, text)


def remove_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the hit words, and what stands between them, cut out of the text; others unchanged.

    The cut texts keep their other characters as they were: pieces between words are addressed by word number.
    """
    at = F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("at")
    hits = scan(_narrow(docs, key, text), benchmark_windows(items)).where("at IS NOT NULL")
    hit = hits.select("k", "t", at).groupBy(
        F.col("k").alias("v_k"), F.col("t").alias("v_t")
    ).agg(F.collect_set("at").alias("hit"))
    joined = keyed(docs, key, text).join(hit, same_row(), "left")
    body = F.col("row")[text]
    # what stands before the first word, then each word with what follows it
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(body, F.lit(WORD_ANY_CASE + gap), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.array_contains("hit", i))
    kept = F.concat(F.regexp_extract(body, f"^{gap}", 0), F.array_join(kept, ""))
    cut = F.when(F.col("hit").isNull(), body).otherwise(kept)
    return joined.withColumn("row", F.col("row").withField(f"`{text}`", cut)).select("row.*")


WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_decontamination", f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({WORDS_SQL.format('text')}, []) AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
         lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT k FROM bw),
dw AS MATERIALIZED (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p,
         unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram
  FROM d, lens WHERE len(w) >= k),
hit AS MATERIALIZED (SELECT doc_id, p, k, gram FROM dw WHERE gram IN (SELECT gram FROM bw)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit JOIN bw USING (gram)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""")  # fmt: skip
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of every document with every benchmark item."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return contamination(docs, items).drop("text_hash")
