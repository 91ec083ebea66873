"""Meet whole rows again after their verdicts were computed on narrow columns.

Rows travel as one struct, so no column name of theirs can clash with a helper's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def named(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row`` (all columns), ``k`` (the key) and ``t`` (a hash of the text)."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(key).alias("k"), F.xxhash64(named(text)).alias("t"))


def same_row() -> Column:
    """The join condition of ``keyed`` rows with verdicts on ``v_k`` and ``v_t``; null keys meet null keys."""
    return F.col("k").eqNullSafe(F.col("v_k")) & F.col("t").eqNullSafe(F.col("v_t"))


def without(docs: DataFrame, bad: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` less the rows whose key and text hash are in ``bad`` (``v_k``, ``v_t``)."""
    return keyed(docs, key, text).join(bad, same_row(), "left_anti").select("row.*")
