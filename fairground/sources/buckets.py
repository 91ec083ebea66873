"""A copy-on-write table in hash buckets of its key.

A row's bucket is a hash of its key, so the buckets a change touches are known from its keys alone: only they are read
and written anew, all other buckets keep their files. ``data/<folder>/bucket=<n>/`` holds one write's buckets;
``_versions/version=<n>/`` is one small file naming the folder of every bucket. A change writes its data first and then
that file, and readers follow the greatest version there is, so they see a change whole or not at all; what a failed
change left behind is never named. The number of buckets is fixed when the table is made (choose it so that a bucket is
a file of reasonable size); the manifest has one row per bucket, and that bounds all that the driver ever holds.

One writer at a time: a change that finds another version committed meanwhile fails and leaves nothing behind. Streams
pass their name and batch number with each change; a replayed batch finds itself in the manifest and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairground.sources import sinks

_MANIFEST = "bucket int, folder string, key string, buckets int, schema string, writers map<string, bigint>"
_HEAD = -1  # the manifest row that is there even when no bucket is


class Conflict(RuntimeError):
    """Another writer committed since this change began."""


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    buckets: int
    schema: str
    folders: dict[int, str]
    writers: dict[str, int] = field(default_factory=dict)


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST + ", version bigint").parquet(f"{path}/_versions")


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The current version, or an earlier one."""
    rows = _versions(spark, path)
    if number is None:
        number = rows.agg(F.max("version")).first()[0]
    rows = rows.where(F.col("version") == number).collect()
    if not rows:
        raise LookupError(f"no version {number} in {path}")
    head = rows[0]
    folders = {r["bucket"]: r["folder"] for r in rows if r["bucket"] != _HEAD}
    return Version(number, head["key"], head["buckets"], head["schema"], folders, dict(head["writers"] or {}))


def _commit(spark: SparkSession, path: str, v: Version) -> None:
    rows = [(b, f, v.key, v.buckets, v.schema, v.writers) for b, f in [(_HEAD, ""), *sorted(v.folders.items())]]
    # one file, so it appears at once; a version that failed before its file was there is written over
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/_versions/version={v.number}")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return not _versions(spark, path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(spark: SparkSession, path: str, schema: str, key: str = "uuid", buckets: int = 256, rows: DataFrame | None = None) -> None:
    """A new table, empty or with ``rows`` (one per key)."""
    if exists(spark, path):
        raise ValueError(f"{path} is a table already")
    empty = Version(0, key, buckets, schema, {})
    folders = _write(spark, path, empty, rows, buckets) if rows is not None else {}
    _commit(spark, path, Version(0, key, buckets, schema, folders))


def _write(spark: SparkSession, path: str, v: Version, rows: DataFrame, parts: int) -> dict[int, str]:
    """Store rows by bucket; the folder of every bucket that has any."""
    folder = f"v{v.number + 1}-{uuid.uuid4().hex}"
    wanted = spark.createDataFrame([], v.schema).columns
    placed = rows.select(*wanted, bucket_of(v.key, v.buckets).alias("bucket"))
    placed.repartition(max(1, parts), "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    stored = spark.read.schema(f"{v.schema}, bucket int").parquet(f"{path}/data/{folder}")
    return {r[0]: folder for r in stored.select("bucket").distinct().collect()}


def read(spark: SparkSession, path: str, number: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
    """All rows, or those of some buckets."""
    v = version(spark, path, number)
    return _read(spark, path, v, v.folders if only is None else only)


def _read(spark: SparkSession, path: str, v: Version, only: Iterable[int]) -> DataFrame:
    paths = [f"{path}/data/{v.folders[b]}/bucket={b}" for b in sorted(set(only) & v.folders.keys())]
    return spark.read.schema(v.schema).parquet(*paths) if paths else spark.createDataFrame([], v.schema)


def _touched(v: Version, keys: DataFrame) -> set[int]:
    """Bucket numbers of some keys; never more than there are buckets."""
    return {r[0] for r in keys.select(bucket_of(v.key, v.buckets)).distinct().collect()}


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (one column named like the table's key); only their buckets are read."""
    v = version(spark, path)
    return _read(spark, path, v, _touched(v, keys)).join(keys.select(v.key), v.key, "left_semi")


def change(
    spark: SparkSession,
    path: str,
    keys: DataFrame,
    make: Callable[[DataFrame], DataFrame],
    writer: str | None = None,
    batch_id: int = 0,
) -> bool:
    """Replace the buckets that ``keys`` fall in by ``make`` of their rows; False if ``writer`` has done so before.

    ``make`` may add, change and remove rows of these keys and must leave others as they are.
    """
    v = version(spark, path)
    if writer is not None and v.writers.get(writer, -1) >= batch_id:
        return False
    touched = _touched(v, keys)
    folders = {b: f for b, f in v.folders.items() if b not in touched}
    if touched:
        folders |= _write(spark, path, v, make(_read(spark, path, v, touched)), len(touched))
    writers = v.writers if writer is None else {**v.writers, writer: batch_id}
    if _versions(spark, path).agg(F.max("version")).first()[0] != v.number:
        raise Conflict(path)
    _commit(spark, path, Version(v.number + 1, v.key, v.buckets, v.schema, folders, writers))
    return True


def upsert(spark: SparkSession, path: str, updates: DataFrame, order: str = "updated_at", **commit) -> bool:
    """Whole rows by key, the last update of a key wins."""
    key = version(spark, path).key
    return change(spark, path, updates, lambda old: sinks.upsert(old, updates, key, order), **commit)


def patch(spark: SparkSession, path: str, updates: DataFrame, columns: list[str], order: str = "updated_at", **commit) -> bool:
    """Some columns of keys that exist."""
    key = version(spark, path).key
    return change(spark, path, updates, lambda old: sinks.patch(old, updates, columns, key, order), **commit)


def overlay(spark: SparkSession, path: str, updates: DataFrame, order: str = "updated_at", **commit) -> bool:
    """Columns that are set, of keys old and new."""
    key = version(spark, path).key
    return change(spark, path, updates, lambda old: sinks.overlay(old, updates, key, order), **commit)


def delete(spark: SparkSession, path: str, keys: DataFrame, **commit) -> bool:
    key = version(spark, path).key
    return change(spark, path, keys, lambda old: sinks.delete_keys(old, keys, key), **commit)


def upsert_children(spark: SparkSession, path: str, updates: DataFrame, parents: str, parent_key: str = "event_uuid",
                    order: str = "updated_at", **commit) -> bool:
    """Rows whose parent exists in the table ``parents``, of which only the parents' buckets are read."""
    key = version(spark, parents).key
    found = lookup(spark, parents, updates.select(F.col(parent_key).alias(key)).distinct())
    return upsert(spark, path, updates.join(found.select(F.col(key).alias(parent_key)), parent_key, "left_semi"), order, **commit)


def expire(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Drop all but the last ``keep`` versions and the data no kept version names. Readers of dropped versions fail."""
    rows = _versions(spark, path)
    numbers = sorted(r[0] for r in rows.select("version").distinct().collect())
    kept = numbers[-max(1, keep) :]
    used = {r[0] for r in rows.where(F.col("version").isin(kept)).select("folder").distinct().collect()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    data = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = data.getFileSystem(conf)
    for number in numbers:
        if number not in kept:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/version={number}"), True)
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)
