"""Duplicates by keyed state: what has been seen is looked up by key, and no stored table is scanned.

State is one value per (title, venue, date): when its item was accepted. It lives in the state store of the key's own
partition, so a batch touches only the keys it brings, whatever the number stored. A key is forgotten ``ttl`` after its
item was accepted: an item that late is new again, whether its timer has fired yet or not, so the result of input that
arrives in order of time doesn't depend on how it is cut into batches. A timer in event time then removes the value,
which bounds the state. Within a batch a key's items go by time; one that arrives after a later one was accepted is a
duplicate of it.

That takes a Python call a key and batch. Keys that are never forgotten don't need it: ``with_new_keys`` and
``mark_batch`` find the same duplicates with Spark's own state of distinct rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ("title", "venue", "date")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "title string, venue string, date string, duplicate boolean, micros bigint, row string"
_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_ITEM = Row("title", "venue", "date", "duplicate", "micros", "row")


class FirstOfKey(StatefulProcessor):
    """Marks every item of a key; the first, and the first after the key was forgotten, are no duplicates.

    A call costs what it asks the state store, so the state is read once and written once, and rows are plain tuples:
    most keys have one item a batch, for which a pandas frame takes longer than the state."""

    def __init__(self, ttl: timedelta | None) -> None:
        self.ttl = None if ttl is None else int(ttl.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "at bigint")

    def _held(self) -> int | None:
        value = self.accepted.get()
        return None if value is None else value[0]

    def _accept(self, at: int, held: int | None) -> None:
        self.accepted.update((at,))
        if self.ttl is not None:
            if held is not None:  # a key has the timer of the time it holds and no other
                self.handle.deleteTimer((held + self.ttl) // 1000 + 1)
            self.handle.registerTimer((at + self.ttl) // 1000 + 1)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        held, at = self._held(), initialState.micros
        if held is None or at > held:
            self._accept(at, held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = sorted((r.micros, r.tie, r.row) for r in rows)
        held = now = self._held()
        out = []
        for at, _, row in got:
            new = now is None or (self.ttl is not None and at >= now + self.ttl)
            now = at if new else now
            out.append(_ITEM(*key, not new, at, row))
        if now != held:
            self._accept(now, held)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.accepted.clear()
        return iter([])

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, ts: str):
    return df.withColumn("micros", F.unix_micros(ts)).groupBy(*KEYS)


def mark_duplicates(
    items: DataFrame,
    ttl: timedelta | None = None,
    late: str = "0 seconds",
    ts: str = "scraped_at",
    stored: DataFrame | None = None,
    tie: str = "uuid",
) -> DataFrame:
    """A stream's items with ``duplicate``; title, venue and date trimmed, null as ''.

    ``stored`` (title, venue, date and ``ts``) is loaded into the state once, before the first batch of a checkpoint;
    after that only the state counts. Items whose time is more than ``late`` behind the newest one are dropped by the
    watermark. Needs ``spark.sql.streaming.stateStore.providerClass`` to be ``PROVIDER``.
    """
    if items.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    trimmed = {k: F.trim(F.coalesce(F.col(k), F.lit(""))) for k in KEYS}
    rows = items.withColumns(trimmed).withColumn(ts, F.coalesce(ts, F.lit(0).cast("timestamp")))
    kept = [c for c in items.columns if c not in (*KEYS, ts)]
    narrow = rows.select(
        *KEYS, F.col(ts).alias("at"), F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("tie"),
        F.to_json(F.struct(*kept), _STAMP).alias("row"),
    ).withWatermark("at", late)
    initial = None if stored is None else _keyed(stored.withColumns(trimmed).select(*KEYS, ts), ts)
    marked = _keyed(narrow, "at").transformWithState(FirstOfKey(ttl), _OUT, "Append", "EventTime", initial)
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*kept).schema)
    back = marked.select(*KEYS, F.timestamp_micros("micros").alias(ts), "duplicate", F.from_json("row", inner, _STAMP).alias("r"))
    return back.select(*[F.col(c) if c in (*KEYS, ts) else F.col(f"r.`{c}`").alias(c) for c in items.columns], "duplicate")


def with_new_keys(items: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A stream's items, keys trimmed, with ``new_key`` false, and a row of nulls with ``new_key`` true for every key that
    neither an earlier batch nor ``stored`` (another stream of keys) has brought. Keys are never forgotten, and no item
    is too late."""
    trimmed = {k: F.trim(F.coalesce(F.col(k), F.lit(""))) for k in KEYS}
    rows = items.withColumns(trimmed)
    keys = rows.select(*KEYS)
    if stored is not None:
        keys = keys.unionByName(stored.withColumns(trimmed).select(*KEYS))
    first = keys.dropDuplicates(list(KEYS)).withColumn("new_key", F.lit(True))
    return rows.withColumn("new_key", F.lit(False)).unionByName(first, allowMissingColumns=True)


def mark_batch(rows: DataFrame, ts: str = "scraped_at", tie: str = "uuid", stored: DataFrame | None = None) -> DataFrame:
    """One batch of ``with_new_keys`` as items with ``duplicate``: the first item of a new key is none. ``stored`` are the
    keys that came with this batch from the other stream; they are new to the state only."""
    if stored is not None:
        known = stored.select(*[F.trim(F.coalesce(F.col(k), F.lit(""))).alias(k) for k in KEYS]).distinct()
        rows = rows.where("NOT new_key").unionByName(rows.where("new_key").join(known, list(KEYS), "left_anti").select(*rows.columns))
    kept = [c for c in rows.columns if c not in (*KEYS, ts, "new_key")]
    order = [F.desc("new_key"), F.asc(ts), F.coalesce(F.col(tie).cast("string"), F.lit("")), F.to_json(F.struct(*kept), _STAMP)]
    ranked = W.partitionBy(*KEYS).orderBy(*order)
    new = F.first("new_key").over(ranked) & (F.row_number().over(ranked) == 2)
    return rows.withColumn("duplicate", ~new).where("NOT new_key").drop("new_key")
