"""Published tables: partitioned JSON, manifest totals, data version."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.functions.text import slug
from bazaarflow.operators.series import PRICE
from bazaarflow.settings import QualitySettings

# Names of the published columns.
GROUP = ("state", "commodity")
OBSERVATION = (
    "date", "min_price", PRICE, "max_price", "arrivals_tonnes", "arrival_coverage",
    "variety_count", "example_variety", "example_variety_basis", "aggregation_method",
    "is_anomaly", "anomaly_score",
)
MARKET = (
    "state_id", "market", "district", "first_date", "last_date", "record_count",
    "weekly_coverage", "latest_age_days", "maximum_gap_days", "price_cv", "coverage_tier",
)


def seasonal(history: DataFrame) -> DataFrame:
    return history.groupBy(*GROUP, "market_id", F.month("date").alias("month")).agg(
        rounded(F.percentile(PRICE, 0.5), 2).alias("median_price"), F.count("*").alias("observations")
    )


def published_rows(history: DataFrame, coverage: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Everything a partition holds, one JSON line per record with its kind.

    A partition is a folder of line-wise JSON, so no task ever assembles a whole partition.
    """
    def records(frame: DataFrame, kind: str, columns, digits: int = 4) -> DataFrame:
        kinds = dict(frame.dtypes)
        values = [rounded(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]
        return frame.select(
            *GROUP, "market_id", F.lit(kind).alias("kind"),
            F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("record"),
        )

    forecast_columns = [c for c in forecasts.columns if c not in (*GROUP, "market_id")]
    rows = (
        records(coverage, "market", MARKET)
        .unionByName(records(history, "observation", OBSERVATION))
        .unionByName(records(forecasts, "forecast", forecast_columns))
        .unionByName(records(seasonal(history), "seasonal", ("month", "median_price", "observations"), 2))
    )
    return rows.withColumn("state_slug", slug(F.col("state"))).withColumn(
        "commodity_slug", slug(F.col("commodity"))
    )


def write_published(rows: DataFrame, folder: str) -> None:
    """Overwriting the whole folder also removes partitions that are no longer produced."""
    rows.write.mode("overwrite").option("compression", "gzip").partitionBy(
        "state_slug", "commodity_slug"
    ).json(folder)


def partition_stats(history: DataFrame, coverage: DataFrame, forecasts: DataFrame) -> DataFrame:
    observed = history.groupBy(*GROUP).agg(
        F.count("*").alias("observation_count"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
    )
    markets = coverage.groupBy(*GROUP).agg(F.count("*").alias("market_count"))
    forecasted = forecasts.groupBy(*GROUP).agg(F.count("*").alias("forecast_count"))
    zero = F.lit(0).cast("long")
    return (
        markets.join(observed, list(GROUP), "left").join(forecasted, list(GROUP), "left")
        .select(
            *GROUP,
            slug(F.col("state")).alias("state_slug"), slug(F.col("commodity")).alias("commodity_slug"),
            "market_count",
            F.coalesce("observation_count", zero).alias("observation_count"),
            F.coalesce("forecast_count", zero).alias("forecast_count"),
            "date_min", "date_max",
        )
        .withColumn("url", F.concat(F.lit("/data/"), "state_slug", F.lit("/"), "commodity_slug", F.lit(".json")))
    )


def stale_partitions(existing: DataFrame, expected: DataFrame, keys=GROUP) -> DataFrame:
    return existing.select(*keys).distinct().join(expected.select(*keys), list(keys), "left_anti")


def manifest_totals(history: DataFrame, coverage: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row; every value is an aggregate, so only totals are combined."""
    dates = history.agg(
        F.count("*").alias("observed_records"), F.min("date").alias("date_min"), F.max("date").alias("date_max")
    )
    places = coverage.agg(
        F.count("*").alias("series"),
        F.count_distinct("market_id").alias("markets"),
        F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"),
        F.array_join(F.array_sort(F.collect_set("commodity")), ",").alias("commodities"),
    )
    outlook = forecasts.agg(
        F.count("*").alias("forecast_records"), F.max("comparison_date").alias("comparison_date")
    )
    # single-row totals side by side
    return dates.select(
        "*",
        places.select(F.struct("*")).scalar().alias("_p"),
        outlook.select(F.struct("*")).scalar().alias("_o"),
    ).select("observed_records", "date_min", "date_max", "_p.*", "_o.*")


def published_summary(history: DataFrame, coverage: DataFrame, quality: QualitySettings) -> DataFrame:
    rows = history.agg(
        F.count("*").alias("records"),
        F.count_distinct("market_id").alias("markets"),
        F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"),
        F.array_join(F.array_sort(F.collect_set("commodity")), ",").alias("commodities"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.count_if("is_anomaly").alias("anomaly_records"),
        F.count_if(F.col("district") == "Unknown").alias("missing_district_records"),
    )
    series = coverage.agg(
        F.count("*").alias("series"),
        F.count_if(F.col("latest_age_days") > quality.stale_after_days).alias("stale_series"),
        F.count_if(F.col("maximum_gap_days") > quality.long_gap_days).alias("long_gap_series"),
    )
    return rows.select("*", series.select(F.struct("*")).scalar().alias("_s")).select(
        *rows.columns, "_s.*"
    )


def coverage_matrix(coverage: DataFrame, commodities: list[str]) -> DataFrame:
    return coverage.groupBy("state").pivot("commodity", commodities).agg(F.count(F.lit(1)))


def manifest_document(totals: DataFrame, partitions: DataFrame) -> DataFrame:
    """Manifest as JSON: one row per (state, commodity), bounded by the two dimensions."""
    listed = partitions.agg(F.array_sort(F.collect_list(F.struct(*partitions.columns))).alias("partitions"))
    return totals.select(
        F.to_json(F.struct(
            F.lit(2).alias("schemaVersion"), F.struct(*totals.columns).alias("meta"),
            listed.scalar().alias("partitions"),
        )).alias("manifest")
    )


def data_version(table: DataFrame) -> str:
    """Twelve hex digits that change with the content of a table, not with its files or row order.

    Row hashes are folded to a count, a sum and an exclusive or, so one small row is combined.
    """
    row = F.xxhash64(*sorted(table.columns))
    folded = table.select(row.alias("h")).agg(
        F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")
    )
    return folded.select(
        F.substring(F.sha2(F.concat_ws("|", "n", "s", "x"), 256), 1, 12)
    ).first()[0]
