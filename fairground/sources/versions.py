"""A table kept as a log of batches: ``path/batch=<id>/``. Readers take the last version of each key.

A batch folder is overwritten as a whole, so replaying a batch after a failure leaves exactly one copy of it. The last
version of a key is the one with the latest ``updated_at``, whoever wrote it; the batch number only breaks ties. A batch
reads the key columns of the whole log to find its keys, so its cost grows with the log: ``compact`` folds it from time
to time, between two batches, into the batch ``FOLDED``, which no writer's number equals.

Updates of some columns need not read the log: they are kept as they came in ``path.patches/batch=<id>/``, numbered on
their own, and ``current`` lays the last one of a key over its row unless the row is newer. A patch of a key that is not
stored waits for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairground.session import shuffles_dropped

FOLDED = -1
TURN_ROWS = 50_000_000  # a turn's rows, some 4 GB of shuffle files as events

Turn = tuple[int, int] | None  # a share of the keys and the number of shares; None: all


def _write(df: DataFrame, path: str, mode: str) -> None:
    """Shuffle files go when the rows are written, not when the driver happens to collect its garbage."""
    with shuffles_dropped(df.sparkSession):
        df.select("*").write.mode(mode).option("compression", "zstd").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    _write(df, f"{path}/batch={batch_id}", "overwrite")


def turns(rows: int) -> list[Turn]:
    """The turns in which so many rows are moved: together, or a share of the keys after the other."""
    n = -(-rows // TURN_ROWS)
    return [(i, n) for i in range(n)] if n > 1 else [None]


def share(df: DataFrame, keys: Sequence[str], turn: Turn) -> DataFrame:
    """The rows whose key has its turn."""
    return df if turn is None else df.where(F.pmod(F.xxhash64(*keys), F.lit(turn[1])) == turn[0])


def write_in_turns(spark: SparkSession, made: Callable[[Turn], DataFrame], rows: int, path: str, batch_id: int) -> None:
    """A batch whose making moves ``rows`` rows. With more than one turn, the disk holds a turn's shuffle files and no more;
    the batch takes its place when all of it is written."""
    all_turns = turns(rows)
    if len(all_turns) == 1:
        return write_batch(made(None), path, batch_id)
    new, place = f"{path}/_batch-{batch_id}", f"{path}/batch={batch_id}"
    for i, turn in enumerate(all_turns):
        _write(made(turn), new, "append" if i else "overwrite")
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(to_path(place), True)
    if not fs.rename(to_path(new), to_path(place)):
        raise OSError(f"{new} could not be renamed to {place}")


def read_log(spark: SparkSession, path: str, schema: str, skip: int | None = None) -> DataFrame:
    """Every row of every batch (but for batch ``skip``, which its writer replaces), with its ``batch``."""
    full = f"{schema.strip()}, batch bigint"
    try:
        df = spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return df if skip is None else df.filter(F.col("batch") != skip)


def current(
    spark: SparkSession, path: str, schema: str, key: str, skip: int | None = None, only: DataFrame | None = None,
    columns: Sequence[str] | None = None, turn: Turn = None,
) -> DataFrame:
    """The last version of each key (of the keys in ``only``, of a turn's share). ``max_by`` keeps one row per key map-side.
    Rows are moved whole, which ``columns`` cuts to those that are wanted."""
    log = share(read_log(spark, path, schema, skip), [key], turn)
    if columns is not None:
        kept = {key, "updated_at", "batch", *columns}
        log = log.select(*[c for c in log.columns if c in kept])
    if only is not None:
        log = log.join(only.select(key), key, "left_semi")
    fields = [c for c in log.columns if c != "batch"]
    order = F.struct("updated_at", "batch") if "updated_at" in fields else F.col("batch")
    rows = log.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r")).select("r.*")
    try:
        patches = spark.read.parquet(f"{path}.patches")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # none, or a first batch that failed
            raise
        return rows if columns is None else rows.select(*columns)
    patches = share(patches, [key], turn)
    if only is not None:
        patches = patches.join(only.select(key), key, "left_semi")
    new = [c for c in patches.columns if c == "updated_at" or c in fields and c != key]
    last = patches.groupBy(key).agg(F.max_by(F.struct(*new), F.struct("updated_at", "batch")).alias("_new"))
    later = F.col("_new").isNotNull() & F.coalesce(F.col("_new.updated_at") >= F.col("updated_at"), F.lit(True))
    picked = [F.when(later, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in fields]
    found = rows.join(last, key, "left").select(*picked)
    return found if columns is None else found.select(*columns)


def write_patches(df: DataFrame, path: str, batch_id: int) -> None:
    """Columns of some keys with ``updated_at``, one row a key, as a batch of patches of the log ``path``."""
    write_batch(df, f"{path}.patches", batch_id)


def compact(spark: SparkSession, path: str, target: str, schema: str, key: str) -> None:
    """Write the current table as the single batch of a new log folder; readers switch to it when it is complete."""
    with shuffles_dropped(spark):
        rows = read_log(spark, path, schema).count()
    write_in_turns(spark, lambda turn: current(spark, path, schema, key, turn=turn), rows, target, FOLDED)
