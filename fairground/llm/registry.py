"""Queries of this subpackage, with the SQL that must return the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("decontamination", "line_dedup", "near_dedup", "host_quality", "html_text", "language", "pii", "sharding", "mixing", "warc", "conversation_repair", "spelling", "topk")


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"fairground.llm.{name}")
