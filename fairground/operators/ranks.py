"""Exact order statistics and row numbers that never gather a whole group in one task.

``percentile`` keeps every distinct value of a group in one task, and ``row_number`` sorts a group in one task.
Both break down when a group holds a third of all rows. Here the values are first cut into buckets at sampled
quantiles; only bucket *counts* are ever windowed per group, and sorting happens per (group, bucket).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

_BUCKETS = 256


_CUT_PROBS = ", ".join(f"{i / _BUCKETS!r}D" for i in range(1, _BUCKETS))


def _cut_points(df: DataFrame, value: str) -> DataFrame:
    """One row holding the 255 approximate quantiles of ``value`` (a bounded sketch)."""
    return df.agg(F.expr(f"percentile_approx(`{value}`, array({_CUT_PROBS}), 10000)").alias("cuts"))


def _with_bucket(df: DataFrame, value: str, cuts: DataFrame) -> DataFrame:
    """Add ``_b``, the bucket of ``value``: a four-way search in the cut points, one projection per level."""
    df = df.withColumn("_cuts", cuts.scalar())
    start, step = "0", _BUCKETS // 4
    while step:
        below = " + ".join(f"int(get(_cuts, {start} + {i * step - 1}) <= `{value}`)" for i in (1, 2, 3))
        df = df.withColumn("_b", F.expr(f"{start} + coalesce({below}, 0) * {step}"))
        start, step = "_b", step // 4
    return df.drop("_cuts")


def _quoted(prefix: str, keys: Sequence[str]) -> list[str]:
    return [f"{prefix}`{k}`" for k in keys]


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"{left}.`{k}` <=> {right}.`{k}`" for k in keys))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value``, one row per group, one column per entry of ``probs``.

    Null and NaN values are ignored. ``exact=False`` uses ``percentile_approx`` (bounded state, one shuffle).
    """
    by, names = list(by), list(probs)
    rows = df.selectExpr(*_quoted("", by), f"double(`{value}`) AS _v").where("_v IS NOT NULL AND NOT isnan(_v)")
    if not exact:
        listed = ", ".join(f"{float(probs[n])!r}D" for n in names)
        out = rows.groupBy(*by).agg(F.expr(f"percentile_approx(_v, array({listed}), 10000)").alias("_q"))
        return out.selectExpr(*_quoted("", by), *[f"get(_q, {i}) AS `{n}`" for i, n in enumerate(names)])

    keys = by or ["_all"]
    if not by:
        rows = rows.selectExpr("0 AS _all", "_v")
    cols = _quoted("", keys)
    group = ", ".join(cols)
    # Identical values collapse map-side, so a hot value or a hot group is spread by value before any ordering.
    # Both readers of the counts below share one shuffle; the filter keeps their plans alike.
    counts = rows.groupBy(*keys, "_v").agg(F.expr("count(1) AS _n"))
    counts = _with_bucket(counts, "_v", _cut_points(counts.where("_n > 0"), "_v"))

    # Which bucket of each group holds each wanted rank: at most 256 rows per group are ordered here.
    sizes = counts.groupBy(*keys, "_b").agg(F.expr("sum(_n) AS _bn")).selectExpr(
        *cols, "_b", "_bn",
        f"sum(_bn) OVER (PARTITION BY {group} ORDER BY _b ROWS UNBOUNDED PRECEDING) - _bn AS _before",
        f"sum(_bn) OVER (PARTITION BY {group}) AS _total",
    )
    ranks = {n: f"({float(p)!r}D * (_total - 1))" for n, p in probs.items()}
    wanted = ", ".join(f"floor({r}), ceil({r})" for r in ranks.values())
    located = sizes.where(f"exists(array({wanted}), r -> r >= _before AND r < _before + _bn)")

    # Only the located buckets are sorted, each on its own.
    inside = counts.alias("c").join(located.alias("h"), _same("c", "h", [*keys, "_b"])).selectExpr(
        *_quoted("c.", keys), "c._b", "_v", "_n", "_before", "_total"
    ).selectExpr(
        *cols, "_v", "_n", "_total",
        f"_before + sum(_n) OVER (PARTITION BY {group}, _b ORDER BY _v ROWS UNBOUNDED PRECEDING) AS _end",
    )
    picks = []
    for i, r in enumerate(ranks.values()):
        for side, rank in (("lo", f"floor({r})"), ("hi", f"ceil({r})")):
            picks.append(F.expr(f"max(CASE WHEN {rank} >= _end - _n AND {rank} < _end THEN _v END) AS _{side}{i}"))
    found = inside.groupBy(*keys).agg(F.expr("max(_total) AS _total"), *picks)
    return found.selectExpr(
        *_quoted("", by),
        *[f"_lo{i} + (_hi{i} - _lo{i}) * ({r} - floor({r})) AS `{n}`" for i, (n, r) in enumerate(ranks.items())],
    )


def row_numbers(df: DataFrame, order: str, by: Sequence[str] = (), name: str = "row_number") -> DataFrame:
    """1-based numbers by the unique numeric column ``order`` inside each ``by`` group, without one task per group."""
    keys = [*by, "_b"]
    rows = _with_bucket(df, order, _cut_points(df, order))
    group = f"PARTITION BY {', '.join(_quoted('', by))}" if by else ""
    offsets = rows.groupBy(*keys).agg(F.expr("count(1) AS _bn")).selectExpr(
        *_quoted("", keys),
        f"coalesce(sum(_bn) OVER ({group} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
    )
    joined = rows.alias("r").join(offsets.alias("o"), _same("r", "o", keys))
    local = f"row_number() OVER (PARTITION BY {', '.join(_quoted('r.', keys))} ORDER BY r.`{order}`)"
    return joined.selectExpr(*_quoted("r.", df.columns), f"o._before + {local} AS `{name}`")


def counts_before(df: DataFrame, order: str, weight: str, by: Sequence[str] = (), name: str = "before") -> DataFrame:
    """For rows with values unique in their ``by`` group: the sum of ``weight`` over the smaller values of the group.

    As ``row_numbers``, for values that were collapsed with their number first, so that a frequent value is one row.
    """
    keys = [*by, "_b"]
    rows = _with_bucket(df, order, _cut_points(df, order))
    group = f"PARTITION BY {', '.join(_quoted('', by))}" if by else ""
    offsets = rows.groupBy(*keys).agg(F.expr(f"sum(`{weight}`) AS _bn")).selectExpr(
        *_quoted("", keys),
        f"coalesce(sum(_bn) OVER ({group} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
    )
    joined = rows.alias("r").join(offsets.alias("o"), _same("r", "o", keys))
    local = f"sum(r.`{weight}`) OVER (PARTITION BY {', '.join(_quoted('r.', keys))} ORDER BY r.`{order}` ROWS UNBOUNDED PRECEDING)"
    return joined.selectExpr(*_quoted("r.", df.columns), f"o._before + {local} - r.`{weight}` AS `{name}`")
