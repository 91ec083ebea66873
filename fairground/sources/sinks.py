"""Write-side operators: each returns the new content of a table, ready to be written as its next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fairground.schemas import ROLES


def _last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` per key. ``max_by`` combines map-side, unlike a ranked window."""
    rows = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_row"))
    return rows.select("_row.*")


def upsert(target: DataFrame, updates: DataFrame, key: str = "uuid", order: str = "updated_at") -> DataFrame:
    """Replace whole rows by key: the latest update wins, keys without an update stay.

    Updates are reduced to one row per key first, so the target is read once and joined by key.
    """
    latest = _last(updates, key, order)
    kept = target.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def _reduced(updates: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """(key, _new): one update per key, the last by ``order`` where the updates have it, then by value."""
    by = [*([order] if order in updates.columns else []), *columns]
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("_new"))


def patch(target: DataFrame, updates: DataFrame, columns: Sequence[str], key: str = "uuid",
          order: str = "updated_at") -> DataFrame:
    """Set ``columns`` of existing keys to the last update's values, null included; unknown keys are ignored."""
    joined = target.join(_reduced(updates, key, columns, order), key, "left")

    def pick(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[pick(c) for c in target.columns])


def overlay(target: DataFrame, updates: DataFrame, key: str = "category", order: str = "updated_at") -> DataFrame:
    """Merge properties by key: the last update's columns win where set, other columns keep the old value; new keys are
    added."""
    fields = [c for c in updates.columns if c != key]
    last = _reduced(updates, key, fields, order)
    joined = target.join(last.select(key, *[F.col(f"_new.{c}").alias(f"_{c}") for c in fields]), key, "full")
    old = set(target.columns)
    merged = [F.coalesce(f"_{c}", c).alias(c) if c in old else F.col(f"_{c}").alias(c) for c in fields]
    return joined.select(key, *[c for c in target.columns if c != key and c not in fields], *merged)


def upsert_children(target: DataFrame, updates: DataFrame, parents: DataFrame, parent_key: str = "event_uuid",
                    key: str = "uuid", order: str = "updated_at") -> DataFrame:
    """Upsert rows whose parent exists; rows without one are not written."""
    ids = parents.select(F.col("uuid").alias(parent_key))
    return upsert(target, updates.join(ids, parent_key, "left_semi"), key, order)


def upsert_summaries(target: DataFrame, updates: DataFrame, events: DataFrame, key: str = "event_uuid",
                     order: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(summaries, event-summary edges): a summary is written even when its event is missing, its edge only if not."""
    summaries = upsert(target, updates, key, order)
    edges = summaries.select(key).join(events.select(F.col("uuid").alias(key)), key, "left_semi")
    return summaries, edges


def delete_keys(target: DataFrame, keys: DataFrame, key: str = "uuid") -> DataFrame:
    return target.join(keys.select(key), key, "left_anti")


def detach(edges: DataFrame, keys: DataFrame, *ends: str, key: str = "uuid") -> DataFrame:
    """Edges without those touching a deleted node at any of their ``ends``."""
    for end in ends:
        edges = edges.join(keys.select(F.col(key).alias(end)), end, "left_anti")
    return edges


def find_or_create(dimension: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Dimension rows plus one per unknown name, keyed by a digest of the name so that reruns agree."""
    kinds = dict(dimension.dtypes)
    new = names.select(name).filter(F.col(name) != "").distinct().join(dimension.select(name), name, "left_anti")
    key = F.sha2(name, 256) if kinds["uuid"] == "string" else F.xxhash64(name)
    return dimension.unionByName(new.select(key.alias("uuid"), name), allowMissingColumns=True)


def check_roles(edges: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Add ``reject_reason``: set for roles outside the accepted list."""
    bad = F.format_string("Invalid relationship type: %s", "role")
    return edges.withColumn("reject_reason", F.when(~F.col("role").isin(*roles), bad))


def upsert_edges(edges: DataFrame, new: DataFrame, people: DataFrame, events: DataFrame) -> DataFrame:
    """Person-event edges with accepted roles and both ends present, each once."""
    good = check_roles(new).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    good = good.join(people.select(F.col("uuid").alias("person_uuid")), "person_uuid", "left_semi")
    good = good.join(events.select(F.col("uuid").alias("event_uuid")), "event_uuid", "left_semi")
    keys = ["person_uuid", "event_uuid", "role"]
    return _added(edges.select(*keys), good.select(*keys), keys)


def _added(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` (each key once) and the keys of ``new`` it lacks. Only the new side is grouped; the stored side is
    read past it, and Spark may broadcast the new side by its measured size."""
    new = new.dropDuplicates(keys)
    known = stored.join(new, keys, "left_semi")
    return stored.unionByName(new.join(known, keys, "left_anti"))


def upsert_same_as(edges: DataFrame, links: DataFrame, stamp: Column) -> DataFrame:
    """Undirected SAME_AS edges, smaller key first; a repeated pair takes the new score."""
    new = links.select(
        F.least("uuid_a", "uuid_b").alias("uuid_a"), F.greatest("uuid_a", "uuid_b").alias("uuid_b"), "score",
        stamp.alias("updated_at"),
    )
    # one new score per pair, the highest; stored pairs are only read past the new ones
    new = new.groupBy("uuid_a", "uuid_b").agg(F.max("score").alias("score"), F.max("updated_at").alias("updated_at"))
    kept = edges.select("uuid_a", "uuid_b", "score", "updated_at").join(new, ["uuid_a", "uuid_b"], "left_anti")
    return kept.unionByName(new)


def replace_members(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Collection members after replacing every collection named in ``chosen``."""
    touched = chosen.select("category").distinct()
    return members.join(touched, "category", "left_anti").unionByName(chosen.select(*members.columns))


def write_members(chosen: DataFrame, path: str) -> None:
    """Overwrite only the partitions of the collections in ``chosen``."""
    (chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category").parquet(path))


def write_report(path: str, generated_at: Column, size: Column, statistics: DataFrame, anomalies: DataFrame) -> None:
    """One JSON document {metadata, statistical_analysis, anomaly_detection} from one-row results."""
    from fairground.operators.stats import one_row

    packed = one_row(
        statistics.select(F.struct("*").alias("statistical_analysis")),
        anomalies.select(F.struct("*").alias("anomaly_detection")),
    )
    meta = F.struct(generated_at.alias("generated_at"), size.alias("dataset_size")).alias("metadata")
    packed.select(meta, "statistical_analysis", "anomaly_detection").write.mode("overwrite").json(path)


def set_embeddings(summary: DataFrame, embeddings: DataFrame, stamp: Column) -> DataFrame:
    """Summaries with new embeddings and update time where one was computed."""
    fresh = embeddings.select("event_uuid", "embedding").withColumn("updated_at", stamp)
    return patch(summary, fresh, ["embedding", "updated_at"], "event_uuid")
