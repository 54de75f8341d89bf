"""Publish with evidence: totals and violations measured while the tables are written, invariants, evidence bundle.

What a scan of the published tables would count is observed on the rows on their way to the files, so checks
cost no second scan. Only what needs the rows of a key together (repeated days, dates of an offset, series) is an
aggregate of its own; it combines before its shuffle. The driver holds one number for each measure.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bazaarflow.operators import files as H
from bazaarflow.operators import publish as B
from bazaarflow.operators import store as K
from bazaarflow.operators import validate as V
from bazaarflow.operators.series import PRICE, SERIES
from bazaarflow.operators.upsert import repeated_keys
from bazaarflow.settings import QualitySettings

# How a market-day price is made.
METHODS = ("arrival-weighted mean of variety modal prices", "median of variety modal prices")


def measures(method: str, days: int, quality: QualitySettings) -> dict[str, dict[str, Column]]:
    """What is observed of each table; names that end in `_violations` count rows that break an invariant."""
    low, high = F.col("min_price"), F.col("max_price")
    return {
        "markets": {
            "series": F.count(F.lit(1)),
            "stale_series": F.count_if(F.col("latest_age_days") > quality.stale_after_days),
            "long_gap_series": F.count_if(F.col("maximum_gap_days") > quality.long_gap_days),
        },
        "observations": {
            "records": F.count(F.lit(1)), "date_min": F.min("date"), "date_max": F.max("date"),
            "anomaly_records": F.count_if(F.col("is_anomaly")),
            "positive_violations": F.count_if(low <= 0),
            "lower_violations": F.count_if(low > F.col(PRICE)),
            "upper_violations": F.count_if(F.col(PRICE) > high),
            "method_violations": F.count_if(~F.col("aggregation_method").isin(*METHODS)),
        },
        "forecasts": {
            "records": F.count(F.lit(1)), "comparison_min": F.min("comparison_date"), "comparison_max": F.max("comparison_date"),
            "offset_violations": F.count_if(~F.col("target_offset_days").between(1, days)),
            "lower_violations": F.count_if(F.col("forecast_low") > F.col("forecast_price")),
            "upper_violations": F.count_if(F.col("forecast_price") > F.col("forecast_high")),
            "method_violations": F.count_if(F.col("method") != method),
        },
        "seasonal": {"records": F.count(F.lit(1))},
    }


@dataclass(frozen=True)
class Published:
    """A written store with what was observed of it."""

    folder: str
    found: Mapping[str, Mapping]
    history: DataFrame
    forecasts: DataFrame
    days: int


def publish(history: DataFrame, coverage: DataFrame, forecasts: DataFrame, method: str, days: int, quality: QualitySettings, folder: str, form: str = "json") -> Published:
    """Writes the published tables, measured. The frames should be stored: each is read for its own table."""
    found = K.write_store(K.sections(history, coverage, forecasts), folder, form, measures=measures(method, days, quality))
    return Published(folder, found, history, forecasts, days)


def invariants(published: Published, window: DataFrame, ledger: DataFrame, partitions: DataFrame) -> DataFrame:
    """(check, measured, holds): what every publication must fulfil.

    window: the history that all series are selected from. ledger: the merged source ledger. partitions: their counts.
    """
    seen, outlook = published.found["observations"], published.found["forecasts"]
    spark = window.sparkSession
    zero, positive = lambda n: n == 0, lambda n: n > 0
    observed = [
        ("history_has_rows", seen["records"], positive), ("prices_are_positive", seen["positive_violations"], zero),
        ("low_is_not_above_price", seen["lower_violations"], zero), ("price_is_not_above_high", seen["upper_violations"], zero),
        ("methods_are_known", seen["method_violations"], zero),
        ("offsets_are_in_the_horizon", outlook["offset_violations"], zero), ("forecast_is_not_below_its_low", outlook["lower_violations"], zero),
        ("forecast_is_not_above_its_high", outlook["upper_violations"], zero), ("one_forecast_method", outlook["method_violations"], zero),
        ("one_comparison_date", int(outlook["comparison_min"] != outlook["comparison_max"]), zero),
    ]
    known = spark.createDataFrame([(n, int(v), bool(f(v))) for n, v, f in observed], "check string, measured long, holds boolean")

    def row(name: str, frame: DataFrame, value: Column, good) -> DataFrame:
        return frame.agg(value.cast("long").alias("measured")).select(F.lit(name).alias("check"), "measured", good(F.col("measured")).alias("holds"))

    none, some = (lambda c: c == 0), (lambda c: c > 0)
    series = published.history.select(*SERIES).distinct()
    per_offset = published.forecasts.groupBy("target_offset_days").agg(F.count_distinct("forecast_date").alias("dates"))
    per_series = published.forecasts.groupBy(*SERIES).agg(F.count("*").alias("n"))
    grouped = [
        row("days_are_unique", repeated_keys(published.history), F.count("*"), none),
        row("window_has_more_rows", window, F.count("*") - F.lit(seen["records"]), some),
        row("window_has_more_series", window.select(*SERIES).distinct().join(series, list(SERIES), "left_anti"), F.count("*"), some),
        row("every_series_has_all_offsets", per_series.filter(F.col("n") != published.days), F.count("*"), none),
        row("one_date_for_each_offset", per_offset.filter("dates > 1"), F.count("*"), none),
        row("ledger_adds_up", ledger, F.coalesce(F.sum(F.abs(F.col("input_records") - F.col("accepted_records") - F.col("excluded_records"))), F.lit(0)), none),
        row("partitions_add_up", partitions, F.coalesce(F.sum("observation_count"), F.lit(0)) - F.lit(seen["records"]), none),
    ]
    for part in grouped:
        known = known.unionByName(part)
    return known


def partition_manifest(spark: SparkSession, published: Published, partitions: DataFrame) -> DataFrame:
    """Counts, bytes, files and content hash of every state and commodity, over all tables."""
    ledger = None
    for name in published.found:
        part = H.partition_ledger(spark, f"{published.folder}/{name}", K.FOLDERS)
        ledger = part if ledger is None else ledger.unionByName(part)
    whole = ledger.groupBy(*K.FOLDERS).agg(
        F.sum("bytes").alias("bytes"), F.sum("files").alias("files"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "").cast("binary"), 256).alias("sha256"))
    return partitions.join(whole, list(K.FOLDERS), "left")


def state_bytes(manifest: DataFrame) -> DataFrame:
    """Totals of each state: partitions, observations and bytes."""
    return manifest.groupBy("state").agg(
        F.count("*").alias("partitions"), F.sum("observation_count").alias("observation_count"), F.sum("bytes").alias("bytes"))


def bundle(published: Published, window: DataFrame, ledger: DataFrame, refreshed_ledger: DataFrame, checks: DataFrame, manifest: DataFrame, method: str) -> DataFrame:
    """The evidence as one JSON document: a row of totals, the checks, and hashes; nothing in it grows with the rows."""
    seen, outlook, places = (published.found[n] for n in ("observations", "forecasts", "markets"))
    quality = lambda frame: V.cumulative_quality(frame).select(F.struct("*")).scalar()
    one = window.agg(F.count("*").alias("records"), F.count_distinct(*SERIES).alias("series"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    held = checks.agg(F.array_sort(F.collect_list(F.struct("check", "measured", "holds")))).scalar()
    totals = manifest.agg(
        F.sum("bytes").alias("total_bytes"), F.count("*").alias("partitions"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "").cast("binary"), 256).alias("sha256"))
    literal = lambda values: F.struct(*(F.lit(v).alias(k) for k, v in values.items()))
    return one.select(F.to_json(F.struct(
        F.lit(2).alias("schemaVersion"),
        F.struct(
            quality(refreshed_ledger).alias("current_refresh_validation"), quality(ledger).alias("cumulative_validation"),
            F.struct(*one.columns).alias("selection_window"), literal({**seen, **places}).alias("published"),
        ).alias("quality"),
        literal({"selected_method": method, "records": outlook["records"], "comparison_date": outlook["comparison_max"]}).alias("model"),
        totals.select(F.struct("*")).scalar().alias("dataset"),
        held.alias("checks"),
    )).alias("evidence"))


def write_bundle(evidence: DataFrame, folder: str) -> None:
    """One row, one file."""
    evidence.coalesce(1).write.mode("overwrite").text(folder)
