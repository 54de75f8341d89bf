"""Roll variety reports up to one observation per market and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarflow.functions.buckets import arrival_coverage
from bazaarflow.functions.numbers import rounded

MARKET_DAY_KEY = ("state_id", "state", "district", "market_id", "market", "commodity", "date")

# The labels published with each observation.
WEIGHTED = "arrival-weighted mean of variety modal prices"
MEDIAN = "median of variety modal prices"
LARGEST = "largest reported arrivals"
ALPHABETICAL = "alphabetical fallback"


def _by_price(accepted: DataFrame) -> DataFrame:
    """Reports counted per variety and price: plain sums and extremes only."""
    arrivals = F.col("arrivals_tonnes")
    return accepted.groupBy(*MARKET_DAY_KEY, "variety", "modal_price").agg(
        F.count("*").alias("rows"),
        F.count(arrivals).alias("rows_with_arrivals"),
        F.min("min_price").alias("low"),
        F.max("max_price").alias("high"),
        F.sum(arrivals).alias("tonnes"),
        F.max(F.coalesce(arrivals, F.lit(-1.0))).alias("largest"),
    )


def _each_report(accepted: DataFrame) -> DataFrame:
    """The same columns for single reports."""
    arrivals, one = F.col("arrivals_tonnes"), F.lit(1).cast("long")
    return accepted.select(
        *MARKET_DAY_KEY, "variety", "modal_price", one.alias("rows"),
        F.when(arrivals.isNotNull(), one).otherwise(0).alias("rows_with_arrivals"),
        F.col("min_price").alias("low"), F.col("max_price").alias("high"),
        arrivals.alias("tonnes"), F.coalesce(arrivals, F.lit(-1.0)).alias("largest"),
    )


def market_days(accepted: DataFrame, deduplicated: bool = False) -> DataFrame:
    """Two grouped aggregates, both combining on the map side.

    The first counts reports per variety and price inside a market-day and spreads a hot market-day
    over many tasks. The second keeps, per market-day, a count per distinct price for the median and
    the set of varieties, so its state grows with distinct values, not with rows.

    Reports that come out of `first_copies` are already spread by variety and price and hardly
    repeat, so `deduplicated` skips the first aggregate and its shuffle.
    """
    modal = F.col("modal_price")
    by_price = _each_report(accepted) if deduplicated else _by_price(accepted)
    grouped = by_price.groupBy(*MARKET_DAY_KEY).agg(
        F.sum("rows").alias("reports"),
        F.sum("rows_with_arrivals").alias("reports_with_arrivals"),
        F.min("low").alias("lowest"),
        F.max("high").alias("highest"),
        F.sum("tonnes").alias("arrivals"),
        F.sum(modal * F.col("tonnes")).alias("weighted"),
        F.percentile(modal, 0.5, F.col("rows")).alias("median"),
        F.size(F.collect_set("variety")).cast("long").alias("variety_count"),
        F.min_by("variety", F.struct(-F.col("largest"), F.col("variety"))).alias("example_variety"),
    )
    total, reported = F.col("reports"), F.col("reports_with_arrivals")
    any_arrivals = reported > 0
    weighable = (reported == total) & (F.col("arrivals") > 0)
    price = F.when(weighable, F.try_divide("weighted", "arrivals")).otherwise(F.col("median"))
    return grouped.select(
        *MARKET_DAY_KEY,
        rounded(F.col("lowest"), 2).alias("min_price"),
        rounded(F.col("highest"), 2).alias("max_price"),
        rounded(price, 2).alias("representative_price"),
        rounded(F.col("arrivals"), 3).alias("arrivals_tonnes"),
        "variety_count",
        "example_variety",
        F.when(any_arrivals, LARGEST).otherwise(ALPHABETICAL).alias("example_variety_basis"),
        F.when(weighable, WEIGHTED).otherwise(MEDIAN).alias("aggregation_method"),
        arrival_coverage(reported, total).alias("arrival_coverage"),
    )


def require_rows(frame: DataFrame, message: str) -> DataFrame:
    if frame.isEmpty():
        raise RuntimeError(message)
    return frame
