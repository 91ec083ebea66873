"""Run a registered query in Spark and its SQL in DuckDB and compare rows regardless of order.

``python -m tests.oracle [sf] [key prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()  # fmt: skip


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if v else 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(_value(x) for x in v.values())
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _canonical(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, key: str, fn, sql: str | None) -> tuple[str, int, float]:
    start = time.time()
    df = fn(spark, sf)
    mine = _canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return "rows-only", len(mine[1]), took
    cur = con.execute(sql)
    theirs = _canonical([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"COLUMNS {mine[0]} <> {theirs[0]}", len(mine[1]), took
    if mine[1] != theirs[1]:
        diff = next(((a, b) for a, b in zip(mine[1], theirs[1]) if a != b), ("", ""))
        return f"VALUES {len(mine[1])} <> {len(theirs[1])} rows; {str(diff[0])[:300]} <> {str(diff[1])[:300]}", len(mine[1]), took
    return "ok", len(mine[1]), took


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from fairground.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    prefixes = tuple(sys.argv[2:])
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for key, fn in entry.queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        try:
            status, n, took = compare(spark, con, sf, key, fn, oracles.get(key))
        except Exception as e:  # report and go on: this is a survey of all queries
            status, n, took = "ERROR " + str(e)[:600], 0, 0.0
        bad += status not in ("ok", "rows-only")
        print(f"{key:36s} {n:7d} rows {took:6.2f}s {status}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
