"""Window operators over one price series: rows of a (commodity, market_id), ordered by date.

A series holds at most one row per calendar day once `keep_last` ran, so its length is bounded by
the days of history. Every operator here partitions by the same two columns; Spark plans one
exchange and one sort for any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarflow.functions.dates import day_number
from bazaarflow.functions.numbers import median_of_sorted, rounded

SERIES = ("commodity", "market_id")
PRICE = "representative_price"

# The robust score of a report against the reports before it.
LOOKBACK_REPORTS = 30
MINIMUM_REPORTS = 8
MAD_TO_SIGMA = 1.4826
MINIMUM_RELATIVE_SCALE = 0.03
ANOMALY_SCORE = 4.0


def by_day() -> Window:
    """Ordered by day number, so frames can be measured in calendar days."""
    return Window.partitionBy(*SERIES).orderBy(day_number(F.col("date")))


def by_report() -> Window:
    """Frames measured in reports; the same order as `by_day`, so both share one sort."""
    return by_day()


def whole_series() -> Window:
    return Window.partitionBy(*SERIES)


def newest_first() -> Window:
    return Window.partitionBy(*SERIES).orderBy(F.col("date").desc())


def last_days(days: int) -> Window:
    return by_day().rangeBetween(-days, 0)


def with_anomaly(history: DataFrame) -> DataFrame:
    """Robust score of each price against the median of the 30 reports before it."""
    earlier = by_report().rowsBetween(-LOOKBACK_REPORTS, -1)
    scored = (
        history.withColumn("_earlier", F.sort_array(F.collect_list(PRICE).over(earlier)))
        .withColumn("_center", median_of_sorted(F.col("_earlier")))
        .withColumn(
            "_spread",
            F.sort_array(F.transform("_earlier", lambda price: F.abs(price - F.col("_center")))),
        )
        .withColumn(
            "_scale",
            F.greatest(
                median_of_sorted(F.col("_spread")) * MAD_TO_SIGMA,
                F.col("_center") * MINIMUM_RELATIVE_SCALE,
                F.lit(1.0),
            ),
        )
    )
    enough = F.size("_earlier") >= MINIMUM_REPORTS
    score = F.when(enough, (F.col(PRICE) - F.col("_center")) / F.col("_scale")).otherwise(0.0)
    return scored.withColumn("_score", score).select(
        *history.columns,
        rounded(F.col("_score"), 4).alias("anomaly_score"),
        (F.abs("_score") >= ANOMALY_SCORE).alias("is_anomaly"),
    )


def days_since_previous() -> Column:
    return F.datediff("date", F.lag("date").over(by_report()))


def asof(days: int, value: str = PRICE) -> Column:
    """Value of the latest report at least `days` old, else the first of the series."""
    backward = by_day().rangeBetween(Window.unboundedPreceding, -days)
    first = F.first(value).over(by_day().rangeBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.last(value).over(backward), first)


def mean_of_last(days: int, value: str = PRICE) -> Column:
    return F.avg(value).over(last_days(days))


def deviation_of_last(days: int, value: str = PRICE) -> Column:
    return F.coalesce(F.stddev_samp(value).over(last_days(days)), F.lit(0.0))


def values_of_last(days: int, value: str = PRICE) -> Column:
    return F.collect_list(value).over(last_days(days))


def mean_of_latest(values: Column, count: int) -> Column:
    """Mean of the last `count` entries of an array."""
    kept = F.least(F.lit(count), F.size(values))
    tail = F.slice(values, -kept, kept)
    return F.aggregate(tail, F.lit(0.0), lambda total, value: total + value) / kept


def following(days: int, value: str = PRICE) -> Column:
    """Reports dated 1..days after the current one, as (date, value) pairs."""
    ahead = by_day().rangeBetween(1, days)
    return F.collect_list(F.struct("date", F.col(value).alias("price"))).over(ahead)


def report_number() -> Column:
    return F.row_number().over(by_report())


def latest_reports(history: DataFrame) -> DataFrame:
    """Newest row per series as a combined maximum: no sort, no window."""
    rest = [c for c in history.columns if c not in SERIES]
    return (
        history.groupBy(*SERIES)
        .agg(F.max_by(F.struct(*rest), F.col("date")).alias("latest"))
        .select(*SERIES, "latest.*")
    )


def newest(history: DataFrame, count: int) -> DataFrame:
    return (
        history.withColumn("_age", F.row_number().over(newest_first()))
        .filter(F.col("_age") <= count)
        .drop("_age")
    )


def within_range(history: DataFrame, days: int | None) -> DataFrame:
    """History relative to the last date of each series; None keeps everything."""
    if days is None:
        return history
    last = F.max("date").over(whole_series())
    return history.withColumn("_last", last).filter(
        F.col("date") >= F.date_sub("_last", days)
    ).drop("_last")


def systematic_sample(history: DataFrame, maximum: int, keep_anomalies: bool = False) -> DataFrame:
    """Every k-th row and the last, with k the smallest step that fits `maximum` rows."""
    index, size = F.row_number().over(by_report()) - 1, F.count("*").over(whole_series())
    numbered = history.withColumn("_index", index).withColumn("_size", size)
    step = F.ceil(F.col("_size") / maximum)
    keep = (F.col("_size") <= maximum) | (F.col("_index") % step == 0) | (
        F.col("_index") == F.col("_size") - 1
    )
    if keep_anomalies:
        keep = keep | F.col("is_anomaly")
    return numbered.filter(keep).drop("_index", "_size")


def missing_days(history: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    span = F.datediff(F.max("date"), F.min("date")) + 1 - F.count("*")
    return history.groupBy(*keys).agg(
        F.count("*").alias("reports"), F.greatest(span, F.lit(0)).cast("long").alias("missing_days")
    )


def calendar(history: DataFrame, days: int) -> DataFrame:
    """The last `days` calendar days of each series with a reported flag."""
    ends = history.groupBy(*SERIES).agg(F.max("date").alias("_last"))
    grid = ends.select(
        *SERIES, F.explode(F.sequence(F.date_sub("_last", days - 1), F.col("_last"))).alias("date")
    )
    reported = history.select(*SERIES, "date", F.lit(True).alias("_seen"))
    return grid.join(reported, [*SERIES, "date"], "left").select(
        *SERIES, "date", F.col("_seen").isNotNull().alias("reported")
    )


def varieties(history: DataFrame) -> DataFrame:
    return history.groupBy(*SERIES).agg(
        F.array_sort(F.collect_set(F.nullif("example_variety", F.lit("")))).alias("varieties")
    )
