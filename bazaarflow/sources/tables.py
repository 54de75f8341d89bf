"""Map order-line tables onto variety reports, raw documents and reference dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.schemas import RAW_DOCUMENT

# File order of a report: unique per row, so it can also serve as its identity.
LINE_POSITION = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "copy")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _placed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with commodity, variety and market.

    The dimensions join one after the other, so Spark sees the size of each and broadcasts it when
    it is below the threshold. Joined among themselves first, their estimated size would multiply
    and the lines would be shuffled for nothing.
    """
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, folder, "region").select("r_regionkey", "r_name")
    place = {
        "state_id": F.col("r_regionkey").cast("long"),
        "state": F.col("r_name"),
        "district": F.col("n_name"),
        "market_id": F.concat_ws("-", F.col("r_regionkey").cast("string"), F.col("n_nationkey").cast("string")),
        "market": F.col("n_name"),
    }
    parts = table(spark, folder, "part").select(
        "p_partkey", F.col("p_type").alias("commodity"), F.col("p_brand").alias("variety")
    )
    modal = rounded(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    scan = table(spark, folder, "lineitem")
    lines = scan.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag",
        "l_discount", "l_tax",
        F.col("l_shipdate").cast("date").alias("date"),
        modal.alias("modal_price"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("arrivals_tonnes"),
    )
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumns(place)
        .withColumn("min_price", rounded(F.col("modal_price") * (1 - F.col("l_discount")), 2))
        .withColumn("max_price", rounded(F.col("modal_price") * (1 + F.col("l_tax")), 2))
    )


def variety_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Clean reports."""
    return _placed_lines(spark, folder).select(
        "state_id", "state", "district", "market_id", "market", "commodity", "variety", "date",
        "min_price", "max_price", "modal_price", "arrivals_tonnes",
    )


def defective_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The same reports with planted defects, in file order, ready for validation.

    Every 50th order is sent twice and the prices, names and arrivals of some line numbers are
    spoiled. The reports keep their position in the file.
    """
    lines = _placed_lines(spark, folder)
    number, tax, discount = F.col("l_linenumber"), F.col("l_tax"), F.col("l_discount")
    low, high = F.col("min_price"), F.col("max_price")
    swapped = number == 7
    zeroed = (number == 4) & (tax < 0.005) & (discount < 0.005)
    copies = F.when(F.col("l_orderkey") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return lines.select(
        *LINE_POSITION[:-1],
        "state_id", "state", "district", "market_id",
        F.when((number == 3) & (tax < 0.005), "").otherwise(F.col("market")).alias("market"),
        "commodity", "variety", "date",
        F.when(zeroed, F.lit(0.0)).when(swapped, high).otherwise(low).alias("min_price"),
        F.when(swapped, low).otherwise(high).alias("max_price"),
        F.when(~((number == 6) & (tax > 0.075)), F.col("modal_price")).alias("modal_price"),
        F.when((number == 5) & (discount > 0.095), -F.col("arrivals_tonnes"))
        .otherwise(F.col("arrivals_tonnes")).alias("arrivals_tonnes"),
        F.date_format("date", "yyyy-MM").alias("source_month"),
        F.explode(copies).alias("copy"),
    )


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Nested source text, one document per order line.

    The values list is empty for first lines without return, the dates are absent for second lines
    without return, and third lines hold two entries, the later one with thousands separators.
    """
    scan = table(spark, folder, "lineitem")
    lines = scan.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag",
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    ).join(
        table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey"),
        F.col("l_suppkey") == F.col("s_suppkey"),
    ).join(
        table(spark, folder, "nation").select("n_nationkey", "n_regionkey"),
        F.col("s_nationkey") == F.col("n_nationkey"),
    )
    modal = F.col("modal")
    plain = F.struct(
        F.when(F.col("l_linenumber") != 4, F.concat(F.lit("Grade "), F.col("l_returnflag"))).alias("variety"),
        rounded(modal * (1 - F.col("l_discount")), 2).cast("decimal(18,2)").cast("string").alias("minimumPrice"),
        rounded(modal * (1 + F.col("l_tax")), 2).cast("decimal(18,2)").cast("string").alias("maximumPrice"),
        modal.cast("decimal(18,2)").cast("string").alias("modalPrice"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("decimal(18,3)").cast("string")).alias("arrivals"),
    )
    spelled = F.struct(
        F.lit("  Other   grade ").alias("variety"),
        F.lit("n/a").alias("minimumPrice"),
        F.format_number(modal, 2).alias("maximumPrice"),
        F.concat(F.lit(" "), F.format_number(modal, 2), F.lit(" ")).alias("modalPrice"),
        F.lit("").alias("arrivals"),
    )
    not_returned = F.col("l_returnflag") == "N"
    entries = (
        F.when((F.col("l_linenumber") == 1) & not_returned, F.slice(F.array(plain), 1, 0))
        .when(F.col("l_linenumber") == 3, F.array(plain, spelled))
        .otherwise(F.array(plain))
    )
    spelling = F.element_at(
        F.array(F.lit("dd/MM/yyyy"), F.lit("yyyy-MM-dd"), F.lit("d-M-yyyy")),
        (F.col("l_orderkey") % 3 + 1).cast("int"),
    )
    written = F.when(spelling == "dd/MM/yyyy", F.date_format("l_shipdate", "dd/MM/yyyy")).when(
        spelling == "yyyy-MM-dd", F.date_format("l_shipdate", "yyyy-MM-dd")
    ).otherwise(F.date_format("l_shipdate", "d-M-yyyy"))
    dated = F.array(F.struct(written.alias("arrivalDate"), entries.alias("data")))
    market = F.struct(
        F.upper("s_name").alias("marketName"),
        F.when(~((F.col("l_linenumber") == 2) & not_returned), dated).alias("dates"),
    )
    return lines.withColumn("modal", rounded(F.col("l_extendedprice") / F.col("l_quantity"), 2)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.col("n_regionkey").cast("long").alias("state_id"),
        F.date_format("l_shipdate", "yyyy-MM").alias("source_month"),
        F.to_json(F.struct(F.lit(True).alias("success"), F.array(market).alias("markets"))).alias("document"),
    )


def parsed_documents(documents: DataFrame) -> DataFrame:
    """Parse document text held in a column with the declared schema."""
    return documents.withColumn("parsed", F.from_json("document", RAW_DOCUMENT)).select(
        *[c for c in documents.columns if c != "document"], "parsed.success", "parsed.markets"
    )


def reference_markets(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as market dimension: every 7th is unknown, every 5th lacks a district.

    Each supplier is listed twice, so the later entry has to win.
    """
    base = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).filter(F.col("s_suppkey") % 7 != 0)
    return base.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("listing"), "*"
    ).select(
        (F.col("s_suppkey") * 2 + F.col("listing")).alias("position"),
        (F.col("s_suppkey") + 1000 * F.col("listing")).alias("id"),
        F.when(F.col("listing") == 1, F.concat(F.lit(" "), F.lower("s_name"), F.lit("  ")))
        .otherwise(F.col("s_name")).alias("mkt_name"),
        F.col("n_regionkey").cast("long").alias("state_id"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("n_nationkey").cast("long")).alias("district_id"),
    )


def reference_districts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").filter(F.col("n_nationkey") != 3).select(
        F.col("n_nationkey").alias("position"),
        F.col("n_nationkey").cast("long").alias("id"),
        F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("district_name"),
    )
