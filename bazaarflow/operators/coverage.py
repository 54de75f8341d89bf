"""Reporting coverage per series, eligibility and selection of the best-covered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bazaarflow.functions.buckets import coverage_tier
from bazaarflow.functions.dates import week_start
from bazaarflow.functions.numbers import rounded
from bazaarflow.operators.series import PRICE, SERIES, days_since_previous, newest
from bazaarflow.operators.upsert import newest_days
from bazaarflow.settings import QualitySettings


def series_coverage(history: DataFrame, quality: QualitySettings) -> DataFrame:
    """One exchange: both windows and the final grouping share the series partitioning."""
    recent = newest_days(history, quality.coverage_window_days)
    end = history.select(F.max("date")).scalar()
    same_price = Window.partitionBy(*SERIES, PRICE)
    measured = recent.withColumn("_gap", days_since_previous()).withColumn(
        "_repeats", F.count("*").over(same_price)
    )
    per_series = measured.groupBy(*SERIES).agg(
        F.min_by(F.struct("state_id", "state", "market", "district"), "date").alias("place"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("record_count"),
        F.size(F.collect_set(week_start(F.col("date")))).cast("long").alias("weeks_reported"),
        F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("maximum_gap_days"),
        F.avg(PRICE).alias("_mean"),
        F.coalesce(F.stddev_samp(PRICE), F.lit(0.0)).alias("_deviation"),
        F.max("_repeats").alias("_most_repeated"),
    )
    first_week, last_week = week_start(F.col("first_date")), week_start(F.col("last_date"))
    possible = F.greatest(F.floor(F.datediff(last_week, first_week) / 7) + 1, F.lit(1))
    rows = per_series.select(
        F.col("place.state_id"), F.col("place.state"), "commodity", "market_id",
        F.col("place.market"), F.col("place.district"),
        "first_date", "last_date", "record_count", "weeks_reported",
        rounded(F.col("weeks_reported") / possible, 4).alias("weekly_coverage"),
        F.datediff(end, "last_date").cast("long").alias("latest_age_days"),
        "maximum_gap_days",
        rounded(F.try_divide("_deviation", F.nullif("_mean", F.lit(0.0))), 4).alias("price_cv"),
        rounded(F.col("_most_repeated") / F.col("record_count"), 4).alias("repeated_price_share"),
    )
    eligible = (
        (F.col("record_count") >= quality.minimum_records)
        & (F.col("weekly_coverage") >= quality.minimum_weekly_coverage)
        & (F.col("latest_age_days") <= quality.maximum_age_days)
    )
    return rows.withColumn("eligible", eligible).withColumn(
        "coverage_tier", coverage_tier(F.col("weekly_coverage"), quality.high_weekly_coverage)
    )


def repeated_price_share(history: DataFrame) -> DataFrame:
    """Two-level aggregate: counts per price combine first, so series length does not matter."""
    counts = history.groupBy(*SERIES, PRICE).agg(F.count("*").alias("n"))
    return counts.groupBy(*SERIES).agg(
        F.sum("n").alias("record_count"),
        rounded(F.max("n") / F.sum("n"), 4).alias("repeated_price_share"),
    )


def selected_series(coverage: DataFrame, per_group: int) -> DataFrame:
    """The best-covered eligible series of each state and commodity."""
    best = Window.partitionBy("state_id", "commodity").orderBy(
        F.col("weekly_coverage").desc(), F.col("record_count").desc(),
        F.col("latest_age_days"), F.col("market_id"),
    )
    return (
        coverage.filter("eligible")
        .withColumn("selection_rank", F.row_number().over(best))
        .filter(F.col("selection_rank") <= per_group)
    )


def with_selected(coverage: DataFrame, per_group: int) -> DataFrame:
    chosen = selected_series(coverage, per_group).select(*SERIES, F.lit(True).alias("_chosen"))
    return coverage.join(chosen, list(SERIES), "left").withColumn(
        "selected", F.col("_chosen").isNotNull()
    ).drop("_chosen")


def restricted_to(history: DataFrame, selection: DataFrame) -> DataFrame:
    return history.join(selection.select(*SERIES), list(SERIES), "left_semi")


def development_sample(history: DataFrame, coverage: DataFrame, series: int, reports: int) -> DataFrame:
    """The first series of each commodity by market name, with their newest reports."""
    by_name = Window.partitionBy("commodity").orderBy("market", "market_id")
    picked = coverage.select(*SERIES, "market").withColumn(
        "_place", F.row_number().over(by_name)
    ).filter(F.col("_place") <= series)
    return newest(restricted_to(history, picked), reports)
