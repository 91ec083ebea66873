"""Read stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder. Columns and filters are pushed to the files by the optimizer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table read with its declared schema (no inference pass over the files)."""
    return spark.read.schema(schema).parquet(path)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A bounded scan: the first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
