"""Leakage-safe features of each report, training rows and forecast rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.functions.buckets import volatility_bucket
from bazaarflow.functions.numbers import median_of_sorted, ratio
from bazaarflow.operators import series as S
from bazaarflow.settings import ModelSettings

# The model inputs, which published models and reports refer to by name.
CATEGORICAL_FEATURES = (
    "state", "commodity", "market_id", "district", "coverage_tier", "volatility_bucket",
    "arrival_coverage",
)
NUMERIC_FEATURES = (
    "lead_days", "current_price", "lag_1d", "lag_7d", "lag_14d", "lag_28d", "rolling_mean_7d",
    "rolling_mean_14d", "rolling_mean_30d", "rolling_mean_90d", "rolling_median_30d",
    "rolling_std_30d", "relative_volatility_30d", "momentum_7d", "current_spread",
    "current_arrivals", "current_arrivals_missing", "reporting_gap_days", "data_age_days",
    "reports_30d", "target_weekday", "target_week", "target_month",
)
BASELINES = {
    "last_observation": "baseline_last",
    "moving_average": "baseline_moving_average",
    "seasonal_naive": "baseline_seasonal_naive",
}
BASELINE_REPORTS = 5


def with_tier(history: DataFrame, coverage: DataFrame, default: str = "standard") -> DataFrame:
    tiers = coverage.select(*S.SERIES, F.col("coverage_tier").alias("_tier"))
    return history.join(tiers, list(S.SERIES), "left").withColumn(
        "coverage_tier", F.coalesce("_tier", F.lit(default))
    ).drop("_tier")


def report_features(history: DataFrame, lead_days: int | None = None) -> DataFrame:
    """Features known on the day of each report. One exchange and one sort for all windows.

    With `lead_days` the later reports within that many days are kept in `_following`; nothing
    else looks ahead.
    """
    price, arrivals = F.col(S.PRICE), F.col("arrivals_tonnes")
    windows = {
        "_number": S.report_number(),
        "_size": F.count("*").over(S.whole_series()),
        "lag_1d": S.asof(1),
        "lag_7d": S.asof(7),
        "lag_14d": S.asof(14),
        "lag_28d": S.asof(28),
        "rolling_mean_7d": S.mean_of_last(7),
        "rolling_mean_14d": S.mean_of_last(14),
        "rolling_mean_30d": S.mean_of_last(30),
        "rolling_mean_90d": S.mean_of_last(90),
        "rolling_std_30d": S.deviation_of_last(30),
        "_values_7d": S.values_of_last(7),
        "_values_30d": S.values_of_last(30),
        "reporting_gap_days": S.days_since_previous(),
    }
    if lead_days is not None:
        windows["_following"] = S.following(lead_days)
    measured = history.withColumns(windows).withColumn(
        "relative_volatility_30d", ratio(F.col("rolling_std_30d"), F.col("rolling_mean_30d"))
    )
    extra = [c for c in history.columns if c.endswith("_level")] + (["_following"] if lead_days is not None else [])
    return measured.select(
        F.col("date").alias("origin_date"),
        "state", "commodity", "market_id", "market", "district", "coverage_tier",
        volatility_bucket(F.col("relative_volatility_30d")).alias("volatility_bucket"),
        "arrival_coverage",
        price.alias("current_price"),
        F.col("min_price").alias("current_min_price"),
        F.col("max_price").alias("current_max_price"),
        F.coalesce(arrivals, F.lit(0.0)).alias("current_arrivals"),
        arrivals.isNull().cast("double").alias("current_arrivals_missing"),
        "lag_1d", "lag_7d", "lag_14d", "lag_28d",
        "rolling_mean_7d", "rolling_mean_14d", "rolling_mean_30d", "rolling_mean_90d",
        median_of_sorted(F.sort_array("_values_30d")).alias("rolling_median_30d"),
        "rolling_std_30d", "relative_volatility_30d",
        (price - F.col("lag_7d")).alias("momentum_7d"),
        (F.col("max_price") - F.col("min_price")).alias("current_spread"),
        F.col("reporting_gap_days").cast("long").alias("reporting_gap_days"),
        F.size("_values_30d").cast("long").alias("reports_30d"),
        price.alias("baseline_last"),
        S.mean_of_latest(F.col("_values_7d"), BASELINE_REPORTS).alias("baseline_moving_average"),
        F.col("lag_7d").alias("baseline_seasonal_naive"),
        "_number", "_size", *extra,
    )


def origins(history: DataFrame, model: ModelSettings, lead_days: int | None = None) -> DataFrame:
    """Reports that may serve as forecast origin: the 9th of a series and later."""
    return report_features(history, lead_days).filter(F.col("_number") >= model.minimum_reports)


def _target_calendar(target: Column) -> dict[str, Column]:
    return {
        "target_weekday": F.weekday(target).cast("long"),
        "target_week": F.weekofyear(target).cast("long"),
        "target_month": F.month(target).cast("long"),
    }


def training_rows(history: DataFrame, model: ModelSettings, since: Column | None = None) -> DataFrame:
    """Every origin with every report of the following 28 days as target.

    With `since` only targets of that date and later, chosen before the rows are multiplied.
    """
    ahead = origins(history, model, model.maximum_lead_days)
    following = F.col("_following")
    if since is not None:
        ahead = ahead.filter(F.col("origin_date") >= F.date_sub(since, model.maximum_lead_days))
        ahead = ahead.withColumn("_since", since)
        following = F.filter("_following", lambda t: t["date"] >= F.col("_since"))
    kept = [c for c in ahead.columns if not c.startswith("_")]
    paired = ahead.select(*kept, F.explode(following).alias("_target"))
    return (
        paired.select(*kept, F.col("_target.date").alias("target_date"), F.col("_target.price").alias("target"))
        .withColumn("lead_days", F.datediff("target_date", "origin_date").cast("long"))
        .withColumn("target_offset_days", F.col("lead_days"))
        .withColumn("data_age_days", F.lit(0).cast("long"))
        .withColumns(_target_calendar(F.col("target_date")))
    )


def latest_target_date(history: DataFrame, model: ModelSettings) -> Column:
    """Last target date of the training rows, as a scalar, without building them.

    A report is a target when the report before it is an origin at most 28 days earlier.
    """
    numbered = history.select(*S.SERIES, "date").withColumns(
        {"_number": S.report_number(), "_gap": S.days_since_previous()}
    )
    return (
        numbered.filter(
            (F.col("_number") > model.minimum_reports) & (F.col("_gap") <= model.maximum_lead_days)
        ).select(F.max("date")).scalar()
    )


def targets_per_report(history: DataFrame, model: ModelSettings) -> DataFrame:
    """(date, targets): training rows that have a report as target, counted without building them."""
    numbered = history.select(*S.SERIES, "date").withColumn("_number", S.report_number())
    before = S.by_day().rangeBetween(-model.maximum_lead_days, -1)
    return numbered.select("date", F.count_if(F.col("_number") >= model.minimum_reports).over(before).alias("targets"))


def forecast_rows(history: DataFrame, model: ModelSettings) -> DataFrame:
    """The last report of each series against the same calendar days after the newest date.

    A series is dropped when any of its leads would exceed the longest trained lead.
    """
    comparison = history.select(F.max("date")).scalar()
    last = report_features(history).filter(
        (F.col("_number") == F.col("_size")) & (F.col("_size") >= model.minimum_reports)
    )
    kept = [c for c in last.columns if not c.startswith("_")]
    return (
        last.select(*kept, comparison.alias("comparison_date"))
        .withColumn("data_age_days", F.datediff("comparison_date", "origin_date").cast("long"))
        .filter(F.col("data_age_days") + model.horizon_days <= model.maximum_lead_days)
        .withColumn("target_offset_days", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(model.horizon_days).cast("long"))))
        .withColumn("target_date", F.date_add("comparison_date", F.col("target_offset_days").cast("int")))
        .withColumn("lead_days", F.col("data_age_days") + F.col("target_offset_days"))
        .withColumns(_target_calendar(F.col("target_date")))
    )
