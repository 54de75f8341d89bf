"""Named bands for volatility, coverage and freshness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def volatility_bucket(relative_volatility: Column) -> Column:
    return (
        F.when(relative_volatility < 0.08, "stable")
        .when(relative_volatility < 0.20, "variable")
        .otherwise("volatile")
    )


def coverage_tier(weekly_coverage: Column, high: float = 0.75) -> Column:
    return F.when(weekly_coverage >= high, "high").otherwise("standard")


def freshness(age_days: Column, threshold: int) -> Column:
    return (
        F.when(age_days <= 2, "fresh").when(age_days <= threshold, "recent").otherwise("stale")
    )


def arrival_coverage(reported: Column, total: Column) -> Column:
    return (
        F.when(reported == total, "complete").when(reported > 0, "partial").otherwise("missing")
    )
