"""Hypothesis tests on prices. Sums are distributed; only one-row (or per-group) statistics reach Python."""

from __future__ import annotations

from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame, functions as F

from fairground.functions import labels
from fairground.functions.pvalues import f_p_value, normal_quantile, normal_tail, t_p_value
from fairground.operators.normalize import priced
from fairground.operators.ranks import counts_before

ALPHA = 0.05
RANKS = 4096  # of equal prices, in one piece


def _group_moments(df: DataFrame) -> DataFrame:
    """n, mean and within-group sum of squares per category; the variance aggregate is numerically stable."""
    return priced(df).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("price").alias("mean"),
        (F.var_pop("price") * F.count(F.lit(1))).alias("ss"),
    )


def anova_statistic(df: DataFrame) -> DataFrame:
    """One-way F statistic over categories; null with fewer than two categories."""
    groups = _group_moments(df)
    grand = groups.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g")).scalar()
    totals = groups.withColumn("_g", grand).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_g"), 2)).alias("between"),
        F.sum("ss").alias("within"),
    )
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    f = F.try_divide(F.col("between") / F.nullif(df1, F.lit(0)), F.col("within") / F.nullif(df2, F.lit(0)))
    return totals.select(
        F.when(F.col("k") > 1, f).alias("f_statistic"), df1.alias("df_between"), df2.alias("df_within")
    )


def anova(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    stat = anova_statistic(df)
    p = f_p_value(F.col("f_statistic"), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    return stat.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def ttest_statistic(df: DataFrame) -> DataFrame:
    """Pooled two-sample t of the cheapest against the dearest category by mean; ties by name."""
    groups = _group_moments(df).withColumn("g", F.struct("category", "n", "mean", "ss"))
    ends = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by("g", F.struct("mean", "category")).alias("a"),
        F.max_by("g", F.struct("mean", "category")).alias("b"),
    ).filter(F.col("k") >= 2)
    dof = F.col("a.n") + F.col("b.n") - 2
    pooled = (F.col("a.ss") + F.col("b.ss")) / F.nullif(dof, F.lit(0))
    spread = F.sqrt(pooled * (1 / F.col("a.n") + 1 / F.col("b.n")))
    return ends.select(
        F.col("a.category").alias("cheapest_category"),
        F.col("b.category").alias("most_expensive_category"),
        (F.col("b.mean") - F.col("a.mean")).alias("price_difference"),
        F.try_divide(F.col("a.mean") - F.col("b.mean"), spread).alias("t_statistic"),
        dof.alias("df"),
    )


def ttest_extremes(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    p = t_p_value(F.col("t_statistic"), F.col("df").cast("double"))
    return ttest_statistic(df).withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def ks_normal(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Kolmogorov-Smirnov against a normal with the data's own mean and sample deviation. Runs two Spark jobs."""
    rows = priced(df).select(F.col("price").cast("double").alias("price"))
    m = rows.agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"), F.count(F.lit(1)).alias("n")).first()
    if m["n"] < 3 or not m["std"]:
        empty = "statistic double, p_value double, is_normal boolean, conclusion string"
        return df.sparkSession.createDataFrame([], empty)
    result = KolmogorovSmirnovTest.test(rows, "price", "norm", m["mean"], m["std"])
    return result.select(
        F.col("statistic"),
        F.col("pValue").alias("p_value"),
        (F.col("pValue") > alpha).alias("is_normal"),
        labels.normality(F.col("pValue")).alias("conclusion"),
    )


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    """Horner form, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def shapiro(df: DataFrame, by: str = "category", max_n: int = 5000, alpha: float = ALPHA) -> DataFrame:
    """Shapiro-Wilk W and p per group (Royston 1995 approximation), all groups in parallel.

    W is given for every group of 3 values or more; its p-value is defined up to ``max_n`` values and null beyond, with
    a note. Equal prices are collapsed to one row with their number before they are ordered by distributed buckets, and
    their ranks are dealt out again in pieces of ``RANKS``, so no task sorts a whole group or holds all of a hot price.
    """
    rows = priced(df).select(by, F.col("price").cast("double").alias("x"))
    counted = rows.groupBy(by, "x").agg(F.count(F.lit(1)).alias("c"))
    sizes = counted.groupBy(by).agg(F.sum("c").alias("n"))
    placed = counts_before(counted, "x", "c", [by]).join(sizes.filter(F.col("n") >= 3), by)
    pieces = placed.withColumn("piece", F.explode(F.expr(f"sequence(0L, (c - 1) div {RANKS})"))).repartition(by, "x", "piece")
    ranks = F.expr(f"sequence(before + piece * {RANKS} + 1, before + least(c, (piece + 1) * {RANKS}))")
    ranked = pieces.select(by, "n", "x", F.explode(ranks).alias("i"))
    scored = ranked.withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))

    n = F.col("n")
    u = 1 / F.sqrt(n)
    edges = scored.groupBy(by, "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.max("m").alias("m_n"),
        F.max(F.when(F.col("i") == n - 1, F.col("m"))).alias("m_n1"),
        F.avg("x").alias("mean"),
    )
    a_n = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(
        _poly((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0), u) + F.col("m_n") / F.sqrt("mm")
    )
    a_n1 = _poly((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0), u) + F.col("m_n1") / F.sqrt("mm")
    edges = edges.withColumn("a_n", a_n).withColumn("a_n1", a_n1)
    two = n > 5
    phi = F.when(
        two,
        (F.col("mm") - 2 * F.pow("m_n", 2) - 2 * F.pow("m_n1", 2)) / (1 - 2 * F.pow("a_n", 2) - 2 * F.pow("a_n1", 2)),
    ).otherwise((F.col("mm") - 2 * F.pow("m_n", 2)) / (1 - 2 * F.pow("a_n", 2)))
    edges = edges.withColumn("phi", phi)

    i = F.col("i")
    coef = (
        F.when(i == n, F.col("a_n")).when(i == 1, -F.col("a_n"))
        .when(two & (i == n - 1), F.col("a_n1")).when(two & (i == 2), -F.col("a_n1"))
        .when(n == 3, F.lit(0.0)).otherwise(F.col("m") / F.sqrt("phi"))
    )
    weighted = scored.join(edges.drop("n"), by).groupBy(by, "n").agg(
        F.sum(coef * F.col("x")).alias("b"), F.sum(F.pow(F.col("x") - F.col("mean"), 2)).alias("ss")
    )
    w = F.least(F.try_divide(F.col("b") * F.col("b"), F.col("ss")), F.lit(1.0))
    tested = weighted.withColumn("statistic", w)

    log_n, y = F.log(n), F.log(1 - F.col("statistic"))
    big = (y - _poly((0.0038915, -0.083751, -0.31082, -1.5861), log_n)) / F.exp(
        _poly((0.0030302, -0.082676, -0.4803), log_n)
    )
    gamma = _poly((0.459, -2.273), n.cast("double"))
    small = (-F.log(gamma - y) - _poly((-0.0006714, 0.025054, -0.39978, 0.5440), n.cast("double"))) / F.exp(
        _poly((-0.0020322, 0.062767, -0.77857, 1.3822), n.cast("double"))
    )
    z = F.when(n <= 11, small).otherwise(big)
    exact3 = 6 / F.pi() * (F.asin(F.sqrt("statistic")) - F.asin(F.sqrt(F.lit(0.75))))
    tested = tested.withColumn("_p", normal_tail(z))
    p = F.when(F.col("statistic") >= 1, F.lit(1.0)).when(n == 3, F.greatest(exact3, F.lit(0.0))).otherwise(F.col("_p"))
    tested = tested.select(by, "statistic", F.when(n <= max_n, p).alias("p_value"))
    return sizes.join(tested, by, "left").select(
        by, "n", "statistic", "p_value",
        (F.col("p_value") > alpha).alias("is_normal"),
        F.when(n > max_n, "Skipped (sample too large for Shapiro-Wilk)").when(n < 3, "Insufficient data").alias("note"),
    )
