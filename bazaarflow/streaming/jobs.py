"""Streaming counterparts of validation, duplicate removal, aggregation and the merge."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from bazaarflow.functions.dates import utc_date
from bazaarflow.operators.upsert import one_per_key
from bazaarflow.operators.validate import DUPLICATE_KEY, REASON, validated
from bazaarflow.schemas import RAW_DOCUMENT
from bazaarflow.settings import QualitySettings
from bazaarflow.sources import raw_json

MONTH = "month"


def arriving_documents(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_DOCUMENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def validated_stream(documents: DataFrame, quality: QualitySettings) -> DataFrame:
    """Flatten and validate arriving documents with the batch expressions."""
    flat = raw_json.flattened(raw_json.market_entries(documents))
    checked = validated(flat, quality.start_date, quality.end_date, quality.maximum_price, "market_raw")
    return checked.withColumn("side", F.when(F.col(REASON).isNull(), "accepted").otherwise("rejected"))


def deduplicated_stream(reports: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Drop repeats that arrive within the delay; state older than the delay is released."""
    return reports.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(DUPLICATE_KEY))


def held_keys(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keys that a finished stream's duplicate removal still holds, read from its state store."""
    return spark.read.format("statestore").load(checkpoint).select("key.*")


def daily_stream(events: DataFrame, event_time: str, delay: str, keys: Sequence[str], value: str) -> DataFrame:
    """Per UTC day and key: count, lowest, highest and total value. Sums are exact decimals."""
    return (
        events.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 day").alias("day"), *keys)
        .agg(
            F.count("*").alias("reports"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
            F.sum(F.col(value).cast("decimal(18,2)")).alias("total"),
        )
        .select(utc_date(F.col("day.start")).alias("date"), *keys, "reports", "lowest", "highest", "total")
    )


def write_to_end(stream: DataFrame, folder: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Append everything available to a folder, then stop."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start(folder).awaitTermination()


def upsert_to_end(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str],
                  order: Sequence[str], mode: str = "append") -> None:
    """Merge every batch into a table by month, keeping the newest row per key.

    A batch reads the months it touches and writes them to a new version folder. Only when that is
    complete a pointer row for each month is appended, in one file; readers follow the newest pointers.
    Whatever fails before leaves the table as it was, and a replayed batch merges again.
    """
    schema = stream.schema.add("_batch", "long").add(MONTH, "string")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = batch.withColumn("_batch", F.lit(batch_id).cast("long")).withColumn(MONTH, F.date_format("date", "yyyy-MM")).persist()
        try:
            # months of the calendar, a bounded list
            months = [row[0] for row in arrived.select(MONTH).distinct().collect()]
            if not months:
                return
            latest = one_per_key(_current(spark, folder, schema, months).unionByName(arrived), keys, [*order, "_batch"])
            version = f"{batch_id:012d}-{uuid.uuid4().hex}"
            kept = latest.select(*[c for c in schema.names if c != MONTH], MONTH, F.col(MONTH).alias("_folder"))
            # AQE splits a large month over several tasks
            kept.hint("rebalance", "_folder").write.partitionBy("_folder").parquet(f"{folder}/data/{version}")
            switch(spark, folder, batch_id, version, months)
        finally:
            arrived.unpersist()

    switch(stream.sparkSession, folder, -1, "", [])
    (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()
    )


_POINTER = "batch long, month string, version string"


def switch(spark: SparkSession, folder: str, batch_id: int, version: str, months: Sequence[str]) -> None:
    """Make a version current for its months; a single small file, so it is there or it is not."""
    rows = [(batch_id, month, version) for month in months]
    spark.createDataFrame(rows, _POINTER).coalesce(1).write.mode("append").parquet(f"{folder}/pointers")


def _current(spark: SparkSession, folder: str, schema: StructType, months: Sequence[str] | None = None) -> DataFrame:
    pointers = spark.read.schema(_POINTER).parquet(f"{folder}/pointers")
    if months is not None:
        pointers = pointers.filter(F.col("month").isin(list(months)))
    # one row for each month of the calendar
    newest = pointers.groupBy("month").agg(F.max_by("version", F.struct("batch", "version")).alias("version")).collect()
    paths = [f"{folder}/data/{row['version']}/_folder={row['month']}" for row in newest]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current_table(spark: SparkSession, folder: str, columns: StructType) -> DataFrame:
    """The merged table as its newest pointers show it."""
    return _current(spark, folder, columns)
