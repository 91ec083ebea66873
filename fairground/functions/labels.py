"""Labels for numbers: distribution shape, correlation strength, variability, completeness, quality."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}
SEVERITY_WEIGHT = {"high": 40, "medium": 20, "low": 10}


def _by_severity(severity: Column, values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[severity]


def severity_rank(severity: Column) -> Column:
    return _by_severity(severity, SEVERITY_RANK)


def severity_weight(severity: Column) -> Column:
    return _by_severity(severity, SEVERITY_WEIGHT)


def shape(skewness: Column) -> Column:
    return (
        F.when(F.abs(skewness) < 0.5, "approximately symmetric")
        .when(skewness > 0, "right-skewed (positively skewed)")
        .otherwise("left-skewed (negatively skewed)")
    )


def tails(kurtosis: Column) -> Column:
    return (
        F.when(F.abs(kurtosis) < 1, "mesokurtic (normal-like tails)")
        .when(kurtosis > 0, "leptokurtic (heavy tails, peaked)")
        .otherwise("platykurtic (light tails, flat)")
    )


def correlation_strength(r: Column) -> Column:
    size = (
        F.when(F.abs(r) >= 0.7, "Strong").when(F.abs(r) >= 0.4, "Moderate").when(F.abs(r) >= 0.3, "Weak")
        .otherwise("Very weak")
    )
    return F.concat(size, F.when(r > 0, " positive").otherwise(" negative"))


def variability(cv: Column) -> Column:
    return F.when(cv > 100, "high").when(cv > 50, "moderate").otherwise("consistent")


def skew_level(skewness: Column) -> Column:
    return F.when(skewness > 1, "strong").when(skewness > 0.5, "moderate").otherwise("symmetric")


def completeness_level(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Fair").otherwise("Poor")


def quality_band(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 6, "medium").otherwise("low")


def normality(p_value: Column) -> Column:
    return F.when(p_value > 0.05, "Normal distribution").otherwise("Non-normal distribution (likely right-skewed)")
