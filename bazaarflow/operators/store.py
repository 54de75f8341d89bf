"""Clustered store of the published tables: typed files that a reader of one series can skip.

Every kind of record is a table of its own below the store's folder, with one folder for each state and
commodity. Rows are dealt out by ranges of (state, commodity, series, then date, offset or month) and sorted
inside, so

- a state and commodity with most of the rows is spread over many tasks and files,
- a table has at most as many files as folders and ranges together (more only where a file would pass
  `rows_per_file`),
- a file, and each row group in it, covers a narrow range of series and dates, which Parquet's statistics tell.

A reader names state, commodity and market: the first two choose folders (partition filters), the market and, for
observations, the dates go to the scan as pushed filters. Nothing else is opened.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.functions.text import slug
from bazaarflow.operators.publish import GROUP, MARKET, OBSERVATION, seasonal

FOLDERS = ("state_slug", "commodity_slug")
# order inside a state and commodity
ORDER = {
    "markets": ("market_id",),
    "observations": ("market_id", "date"),
    "forecasts": ("market_id", "target_offset_days"),
    "seasonal": ("market_id", "month"),
}
ROWS_PER_FILE = 5_000_000


def sections(history: DataFrame, coverage: DataFrame, forecasts: DataFrame) -> dict[str, DataFrame]:
    """The published records by kind, with typed columns; numbers on the published digits."""
    def typed(frame: DataFrame, columns, digits: int = 4) -> DataFrame:
        kinds = dict(frame.dtypes)
        return frame.select(*GROUP, "market_id", *(
            rounded(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns if c not in (*GROUP, "market_id")
        ))

    return {
        "markets": typed(coverage, MARKET),
        "observations": typed(history, OBSERVATION),
        "forecasts": typed(forecasts, forecasts.columns),
        "seasonal": typed(seasonal(history), ("month", "median_price", "observations"), 2),
    }


def write_store(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet", rows_per_file: int = ROWS_PER_FILE,
                measures: Mapping[str, Mapping[str, Column]] | None = None) -> dict[str, dict]:
    """Each table below folder, as Parquet or as JSON lines with one typed record each.

    measures (table -> name -> aggregate) are taken from the rows on their way to the files and returned. They are
    observed behind the exchange: the sampling of ranges reads the rows once more and must not be counted.
    """
    found = {}
    for name, frame in tables.items():
        keyed = frame.withColumns({FOLDERS[0]: slug(F.col("state")), FOLDERS[1]: slug(F.col("commodity"))})
        order = [*FOLDERS, *ORDER[name]]
        dealt, watch = keyed.repartitionByRange(*order).sortWithinPartitions(*order), Observation()
        wanted = dict((measures or {}).get(name, {}))
        if wanted:
            dealt = dealt.observe(watch, *(column.alias(label) for label, column in wanted.items()))
        writer = dealt.write.mode("overwrite").partitionBy(*FOLDERS).option("maxRecordsPerFile", rows_per_file)
        if form == "json":
            writer.option("compression", "gzip").option("ignoreNullFields", "false").json(f"{folder}/{name}")
        else:
            writer.option("compression", "zstd").format(form).save(f"{folder}/{name}")
        if wanted:
            found[name] = watch.get
    return found


def read_table(spark: SparkSession, folder: str, name: str, form: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema is not None else reader).load(f"{folder}/{name}")


def of_group(frame: DataFrame, state: str, commodity: str) -> DataFrame:
    """Rows of one state and commodity; the slugs are constants, so only their folder is listed."""
    here = lambda name, value: F.col(name) == slug(F.lit(value))
    # two names may share a slug
    return frame.filter(here(FOLDERS[0], state) & here(FOLDERS[1], commodity) & (F.col("state") == state) & (F.col("commodity") == commodity))


@dataclass(frozen=True)
class MarketDetail:
    """What the store holds of one series, each part in its order."""

    market: DataFrame
    observations: DataFrame
    forecasts: DataFrame
    seasonal: DataFrame

    def rows(self) -> DataFrame:
        """All parts in one frame, with the part's name."""
        result = None
        for name in ("market", "observations", "forecasts", "seasonal"):
            part = getattr(self, name).select(F.lit(name).alias("part"), "*")
            result = part if result is None else result.unionByName(part, allowMissingColumns=True)
        return result


def market_detail(spark: SparkSession, folder: str, state: str, commodity: str, market_id: str, since: date | None = None, until: date | None = None) -> MarketDetail:
    """Observations by date, forecasts by offset and seasonal medians by month of one market and commodity."""
    def part(name: str, *more: Column) -> DataFrame:
        found = of_group(read_table(spark, folder, name), state, commodity).filter(F.col("market_id") == market_id)
        for condition in more:
            found = found.filter(condition)
        return found.drop(*FOLDERS).orderBy(*ORDER[name][1:] or ORDER[name])

    days = [F.col("date") >= F.lit(since)] * (since is not None) + [F.col("date") <= F.lit(until)] * (until is not None)
    return MarketDetail(part("markets"), part("observations", *days), part("forecasts"), part("seasonal"))
