"""Validation with one reason per rejected report, duplicate removal and the quality ledger."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.functions.text import casefolded

REASON = "exclusion_reason"
DUPLICATE_KEY = (
    "market_id", "commodity", "variety_key", "date", "min_price", "max_price", "modal_price"
)


def reject_reason(start: date, end: date, ceiling: float, market: str = "market") -> Column:
    """The first rule a report breaks, null when it breaks none."""
    low, high, modal, arrivals = (
        F.col("min_price"), F.col("max_price"), F.col("modal_price"), F.col("arrivals_tonnes")
    )
    nameless = F.col(market).isNull() | (F.col(market) == "")
    return (
        F.when(nameless | F.col("date").isNull(), "missing_identity_or_invalid_date")
        .when(~F.col("date").between(F.lit(start), F.lit(end)), "outside_requested_date_range")
        .when(low.isNull() | high.isNull() | modal.isNull(), "unparseable_price")
        .when(F.least(low, high, modal) <= 0, "non_positive_price")
        .when(F.greatest(low, high, modal) > ceiling, "price_above_safety_ceiling")
        .when(~((low <= modal) & (modal <= high)), "invalid_price_order")
        .when(arrivals < 0, "negative_arrivals")
    )


def validated(reports: DataFrame, start: date, end: date, ceiling: float, market: str = "market") -> DataFrame:
    return reports.withColumn(REASON, reject_reason(start, end, ceiling, market)).withColumn(
        "variety_key", casefolded(F.col("variety"))
    )


def first_copies(checked: DataFrame, position: Sequence[str]) -> DataFrame:
    """Accepted reports only: of equal reports the earliest in file order.

    A grouped minimum combines on the map side, so any number of copies of one report shrinks to
    one row per task before the shuffle.
    """
    rest = [c for c in checked.columns if c not in DUPLICATE_KEY and c != REASON]
    return (
        checked.filter(F.col(REASON).isNull())
        .groupBy(*DUPLICATE_KEY)
        .agg(F.min_by(F.struct(*rest), F.struct(*position)).alias("first"))
        .select(*DUPLICATE_KEY, "first.*")
    )


def with_duplicates_marked(checked: DataFrame, position: Sequence[str]) -> DataFrame:
    """Every report with its reason, later copies marked `exact_duplicate`.

    Only keys with several reports matter. Their first position is a combined minimum; that small
    result joins the reports by key, so a hot key is a skewed side Spark splits or a broadcast match.
    """
    repeated = (
        checked.filter(F.col(REASON).isNull())
        .groupBy(*(F.col(k).alias(f"_key_{k}") for k in DUPLICATE_KEY))
        .agg(F.min(F.struct(*position)).alias("_first"), F.count("*").alias("_copies"))
        .filter("_copies > 1").drop("_copies")
    )
    same = F.col(REASON).isNull()
    for key in DUPLICATE_KEY:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    later = F.col("_first").isNotNull() & (F.struct(*position) != F.col("_first"))
    return checked.join(repeated, same, "left").select(
        *(F.when(later, "exact_duplicate").otherwise(F.col(REASON)).alias(REASON) if c == REASON else F.col(c) for c in checked.columns)
    )


def split(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    reason = F.col(REASON)
    return marked.filter(reason.isNull()).drop(REASON), marked.filter(reason.isNotNull())


def reasons_json(pairs: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))


def quality_ledger(marked: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per source file, files without rows included. Reasons combine before the group."""
    keys = list(keys)
    counted = marked.groupBy(*keys, REASON).agg(F.count("*").alias("n"))
    per_file = counted.groupBy(*keys).agg(
        F.sum("n").alias("input_records"),
        F.sum(F.when(F.col(REASON).isNull(), F.col("n")).otherwise(0)).alias("accepted_records"),
        F.sum(F.when(F.col(REASON).isNotNull(), F.col("n")).otherwise(0)).alias("excluded_records"),
        F.collect_list(F.when(F.col(REASON).isNotNull(), F.struct(REASON, "n"))).alias("reasons"),
    )
    empty = F.lit(0).cast("long")
    return files.join(per_file, keys, "left").select(
        *files.columns,
        *(F.coalesce(c, empty).alias(c) for c in ("input_records", "accepted_records", "excluded_records")),
        F.coalesce(reasons_json(F.col("reasons")), F.lit("{}")).alias("exclusion_reasons_json"),
    )


def reason_counts(marked: DataFrame) -> DataFrame:
    return (
        marked.filter(F.col(REASON).isNotNull())
        .groupBy(REASON)
        .agg(F.count("*").alias("n"))
        .withColumn("label", F.replace(F.col(REASON), F.lit("_"), F.lit(" ")))
    )


def cumulative_quality(ledger: DataFrame) -> DataFrame:
    totals = [F.sum(c).alias(c) for c in ("input_records", "accepted_records", "excluded_records")]
    return ledger.agg(F.count("*").alias("source_file_count"), *totals).withColumn(
        "reconciles",
        F.col("input_records") == F.col("accepted_records") + F.col("excluded_records"),
    )


def entry_corrections(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per file, market entries whose name changed for display and entries left unresolved."""
    return entries.groupBy(*keys).agg(
        F.count("*").alias("market_entries"),
        F.count_if(F.col("market") != F.col("market_raw")).alias("corrected_records"),
        F.count_if(~F.col("resolved")).alias("unresolved_market_references"),
    )
