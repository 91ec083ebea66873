"""Registered queries: each operator bound to the supplied tables, beside the SQL that checks it."""

from importlib import import_module

MODULES = ("statistics", "dashboards", "anomalies", "catalogue", "linking", "retrieval", "fields", "streams", "growing")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"fairground.plans.{name}")
