"""Scan, discover and flatten the nested monthly documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bazaarflow.functions.dates import month_key, parse_report_date
from bazaarflow.functions.numbers import parse_number
from bazaarflow.functions.text import variety_name
from bazaarflow.schemas import RAW_DOCUMENT

# Fixed value: where a document lies, .../<state id>-<state>/<commodity>/<year-month>.json, or in
# the older layout .../<commodity>/<year-month>.json.
CURRENT_LAYOUT = r"/([0-9]+)-[^/]*/([^/]+)/([0-9]{4}-[0-9]{2})\.json$"
LEGACY_LAYOUT = r"/([^/]+)/([0-9]{4}-[0-9]{2})\.json$"
POSITION = ("state_position", "commodity_position", "source_month",
            "market_position", "date_position", "value_position")


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per document with the file it came from."""
    return (
        spark.read.schema(RAW_DOCUMENT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(paths)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def located(files: DataFrame, legacy_state_id: int | None = None) -> DataFrame:
    """Read state, commodity slug, month and layout priority off the file path."""
    path = F.col("source_file")
    current = F.regexp_extract(path, CURRENT_LAYOUT, 1)
    is_current = current != ""
    return files.select(
        "*",
        F.when(is_current, current.try_cast("long"))
        .otherwise(F.lit(legacy_state_id).cast("long"))
        .alias("state_id"),
        F.when(is_current, F.regexp_extract(path, CURRENT_LAYOUT, 2))
        .otherwise(F.regexp_extract(path, LEGACY_LAYOUT, 1))
        .alias("commodity_slug"),
        F.regexp_extract(path, LEGACY_LAYOUT, 2).alias("source_month"),
        is_current.cast("int").alias("layout_priority"),
    )


def within_months(files: DataFrame, start: Column, end: Column) -> DataFrame:
    return files.filter(F.col("source_month").between(month_key(start), month_key(end)))


def latest_layout(files: DataFrame, keys: Iterable[str] = ("state_id", "commodity_slug", "source_month")) -> DataFrame:
    """The current layout overrides the older file of the same month.

    One aggregate with map-side combine; the document bodies are joined afterwards by path.
    """
    keys = list(keys)
    return files.groupBy(*keys).agg(
        F.max_by("source_file", F.struct("layout_priority", "source_file")).alias("source_file"),
        F.max("layout_priority").alias("layout_priority"),
    )


def row_count(markets: Column) -> Column:
    """Rows a document stands for: an empty list of values still counts one."""
    per_date = lambda entry: F.greatest(F.coalesce(F.size(entry["data"]), F.lit(0)), F.lit(1))
    per_market = lambda market: F.aggregate(
        F.coalesce(market["dates"], F.array().cast(RAW_DOCUMENT["markets"].dataType.elementType["dates"].dataType)),
        F.lit(0),
        lambda total, entry: total + per_date(entry),
    )
    return F.coalesce(
        F.aggregate(markets, F.lit(0), lambda total, market: total + per_market(market)), F.lit(0)
    ).cast("long")


def market_entries(documents: DataFrame) -> DataFrame:
    """One row per market entry. All other columns of the document are kept.

    Lists are unfolded with a row for empty ones, which is dropped afterwards: for a plain `posexplode` Spark adds a filter
    on the list, which it pushes into the joins below, where every document is parsed once more for it.
    """
    kept = [c for c in documents.columns if c not in ("markets", "success")]
    return documents.select(
        *kept, F.posexplode_outer("markets").alias("market_position", "entry")
    ).filter(F.col("market_position").isNotNull()).select(*kept, "market_position", F.trim("entry.marketName").alias("market_raw"), "entry.dates")


def flattened(entries: DataFrame) -> DataFrame:
    """markets[] -> dates[] -> data[]; a date without values yields one row of nulls."""
    kept = [c for c in entries.columns if c != "dates"]
    dated = entries.select(*kept, F.posexplode_outer("dates").alias("date_position", "dated")).filter(F.col("date_position").isNotNull())
    valued = dated.select(
        *kept,
        "date_position",
        F.col("dated.arrivalDate").alias("arrival_date"),
        F.posexplode_outer("dated.data").alias("value_position", "value"),
    )
    return valued.select(
        *kept,
        "date_position",
        F.coalesce("value_position", F.lit(0)).alias("value_position"),
        parse_report_date(F.col("arrival_date")).alias("date"),
        variety_name(F.col("value.variety")).alias("variety"),
        parse_number(F.col("value.minimumPrice")).alias("min_price"),
        parse_number(F.col("value.maximumPrice")).alias("max_price"),
        parse_number(F.col("value.modalPrice")).alias("modal_price"),
        parse_number(F.col("value.arrivals")).alias("arrivals_tonnes"),
    )
