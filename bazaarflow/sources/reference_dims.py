"""Market and district lookups, and resolving reports against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.functions.text import derived_market_id, display_name, normalized_key
from bazaarflow.schemas import REFERENCE_DOCUMENT


def read_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    document = spark.read.schema(REFERENCE_DOCUMENT).option("multiLine", True).json(path)
    markets = document.select(F.posexplode("data.market_data").alias("position", "m")).select(
        "position", "m.*"
    )
    districts = document.select(F.posexplode("data.district_data").alias("position", "d")).select(
        "position", "d.*"
    )
    return markets, districts


def market_lookup(markets: DataFrame, state_ids: list[int] | None = None) -> DataFrame:
    """One row per (state, normalized name); of repeated names the last entry counts."""
    usable = markets.filter(
        F.col("mkt_name").isNotNull() & (F.col("mkt_name") != "") & F.col("state_id").isNotNull()
    )
    if state_ids is not None:
        usable = usable.filter(F.col("state_id").isin(state_ids))
    return (
        usable.groupBy("state_id", normalized_key(F.col("mkt_name")).alias("market_key"))
        .agg(F.max_by(F.struct("id", "district_id"), F.col("position")).alias("found"))
        .select(
            "state_id",
            "market_key",
            F.col("found.id").alias("reference_id"),
            F.col("found.district_id").alias("district_id"),
        )
    )


def district_lookup(districts: DataFrame) -> DataFrame:
    return (
        districts.filter(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("district_id"))
        .agg(F.trim(F.max_by("district_name", "position")).alias("district"))
    )


def resolve_markets(reports: DataFrame, markets: DataFrame, districts: DataFrame) -> DataFrame:
    """Attach market id, display name and district; unknown markets get a derived id.

    Both lookups are plain left joins, one after the other: Spark broadcasts each while it stays
    below spark.sql.autoBroadcastJoinThreshold and shuffles otherwise.
    """
    joined = (
        reports.withColumn("market_key", normalized_key(F.col("market_raw")))
        .join(markets, ["state_id", "market_key"], "left")
        .join(districts, "district_id", "left")
    )
    known = F.col("reference_id").isNotNull()
    return joined.select(
        *reports.columns,
        F.when(known, F.concat_ws("-", F.col("state_id").cast("string"), F.col("reference_id").cast("string")))
        .otherwise(derived_market_id(F.col("state_id"), F.col("market_raw")))
        .alias("market_id"),
        display_name(F.col("market_raw")).alias("market"),
        F.coalesce("district", F.lit("Unknown")).alias("district"),
        known.alias("resolved"),
    )
