"""Sharding by a permutation-filled lookup table.

Every shard walks its own permutation of a prime-sized table and claims the next free slot in its turn, until the
table is full. A document goes to the shard that holds the slot of its key's hash. Shards end up with shares that
differ by at most one slot, and changing the shard list moves few documents. The table has ``slots`` rows whatever the
data's size, so broadcasting it is safe and placing a document is one hash and one lookup.

Defined cases: a null key is placed by the hash of ``fallback`` columns (all null: the hash of nothing, one fixed
slot), so rows without a key spread out too. Rows with equal keys share a shard. An empty table gives an empty result.
Columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairground.llm.registry import query

SLOTS = 65_537  # prime, and far above the number of shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """slot -> index into ``shards``. ``slots`` must be prime and at least the number of shards; names must differ."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be given and differ")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    at = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "skip") % (slots - 1) + 1 if slots > 1 else 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def place(
    docs: DataFrame,
    key: str = "doc_id",
    fallback: tuple[str, ...] = ("text",),
    shards: tuple[str, ...] = SHARDS,
    slots: int = SLOTS,
) -> DataFrame:
    """``docs`` with ``slot`` (long) and ``shard`` (string)."""
    spark = docs.sparkSession
    table = lookup_table(shards, slots)
    owner = spark.createDataFrame([(s, shards[i]) for s, i in enumerate(table)], "slot long, shard string")
    own = [c for c in fallback if c in docs.columns]
    value = F.xxhash64(F.col(key))
    if own:
        value = F.when(F.col(key).isNull(), F.xxhash64(*own)).otherwise(value)
    slotted = docs.drop("shard").withColumn("slot", F.pmod(value, F.lit(slots)))
    return slotted.join(F.broadcast(owner), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


@query("op8_sharding")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's slot and shard."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return place(docs.select("doc_id", "text")).select("doc_id", "slot", "shard")
