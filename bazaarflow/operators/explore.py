"""Read-only queries over the published tables: catalog, search, facets, paging, detail."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from bazaarflow.functions.buckets import freshness
from bazaarflow.functions.numbers import price_position, rounded
from bazaarflow.functions.text import mentions, series_key, slug
from bazaarflow.operators import series as S

PAGE_SIZE = 18
SPARKLINE_REPORTS, SPARKLINE_POINTS = 120, 18
COMMODITY_DAYS, COMMODITY_POINTS = 90, 24


def sparkline_points(history: DataFrame) -> DataFrame:
    recent = S.newest(history.select(*S.SERIES, "date", S.PRICE), SPARKLINE_REPORTS)
    return S.systematic_sample(recent, SPARKLINE_POINTS)


def catalog(coverage: DataFrame, history: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per series with its latest report, varieties, sparkline and forecasts.

    All sides are keyed by series and hold at most one row per day, so the arrays stay small.
    Series without observations drop out.
    """
    per_series = history.groupBy(*S.SERIES).agg(
        F.max_by(F.struct("date", "min_price", S.PRICE, "max_price", "arrivals_tonnes", "is_anomaly"), "date").alias("latest"),
        F.array_sort(F.collect_set(F.nullif("example_variety", F.lit("")))).alias("varieties"),
        (F.count("arrivals_tonnes") > 0).alias("has_arrivals"),
    )
    lines = sparkline_points(history).groupBy(*S.SERIES).agg(
        F.array_sort(F.collect_list(F.struct("date", F.col(S.PRICE).alias("value")))).alias("sparkline")
    )
    outlook = forecasts.groupBy(*S.SERIES).agg(
        F.array_sort(F.collect_list(F.struct("target_offset_days", "forecast_date", "forecast_price", "forecast_low", "forecast_high"))).alias("forecasts")
    )
    keys = list(S.SERIES)
    return (
        coverage.join(per_series, keys).join(lines, keys).join(outlook, keys, "left")
        .withColumn("state_slug", slug(F.col("state")))
        .withColumn("commodity_slug", slug(F.col("commodity")))
        .withColumn("key", series_key(F.col("state"), F.col("commodity"), F.col("market_id")))
        .withColumn("route", F.concat(F.lit("/markets/"), "key"))
        .withColumn("forecast_count", F.coalesce(F.size("forecasts"), F.lit(0)))
    )


def state_rollup(markets: DataFrame, observations: DataFrame, threshold: int) -> DataFrame:
    fresh = freshness(F.col("latest_age_days"), threshold)
    counted = observations.groupBy("state").agg(F.count("*").alias("observation_count"))
    return markets.groupBy("state").agg(
        F.count_distinct("commodity").alias("commodity_count"),
        F.count_distinct("market_id").alias("market_count"),
        F.count_distinct("district").alias("district_count"),
        F.count("*").alias("series_count"),
        F.max("last_date").alias("latest_date"),
        *(F.count_if(fresh == name).alias(f"{name}_series") for name in ("fresh", "recent", "stale")),
    ).join(counted, "state")


def commodity_rollup(markets: DataFrame, threshold: int) -> DataFrame:
    """`markets` carries the latest price of each series as `latest_price`."""
    return markets.groupBy("commodity").agg(
        F.count_distinct("market_id").alias("market_count"),
        F.count("*").alias("series_count"),
        F.max("last_date").alias("latest_date"),
        F.min("latest_price").alias("latest_min"),
        F.max("latest_price").alias("latest_max"),
        F.count_if(freshness(F.col("latest_age_days"), threshold) == "fresh").alias("fresh_series"),
    )


def upper_median_by_date(points: DataFrame, keys=("commodity", "date")) -> DataFrame:
    """The value at position floor(n/2) of the sorted values of a day.

    Equal values combine first; the position is found on running counts, so no list of a day's
    series is collected.
    """
    keys = list(keys)
    counts = points.groupBy(*keys, F.col(S.PRICE).alias("value")).agg(F.count("*").alias("n"))
    upward = Window.partitionBy(*keys).orderBy("value")
    ranked = counts.withColumn("upto", F.sum("n").over(upward)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*keys))
    )
    position = F.floor(F.col("total") / 2)
    return ranked.filter(
        (F.col("upto") > position) & (F.col("upto") - F.col("n") <= position)
    ).select(*keys, "value")


def commodity_sparkline(points: DataFrame) -> DataFrame:
    """Pooled daily value per commodity: last 90 days with reports, thinned to 24 points."""
    pooled = upper_median_by_date(points)
    newest = Window.partitionBy("commodity").orderBy(F.col("date").desc())
    upward = Window.partitionBy("commodity").orderBy("date")
    recent = pooled.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= COMMODITY_DAYS)
    numbered = recent.withColumns({
        "_index": F.row_number().over(upward) - 1,
        "_size": F.count("*").over(Window.partitionBy("commodity")),
    })
    step = F.ceil(F.col("_size") / COMMODITY_POINTS)
    keep = (F.col("_size") <= COMMODITY_POINTS) | (F.col("_index") % step == 0) | (F.col("_index") == F.col("_size") - 1)
    return numbered.filter(keep).select("commodity", "date", "value")


def catalog_totals(markets: DataFrame) -> DataFrame:
    names = markets.select(F.explode("varieties").alias("variety")).agg(
        F.array_join(F.array_sort(F.collect_set("variety")), ",")
    ).scalar()
    return markets.agg(
        F.count_distinct("district").alias("districts"),
        F.array_join(F.array_sort(F.collect_set("district")), ",").alias("district_names"),
        F.count_distinct(F.when(F.col("has_arrivals"), F.col("market_id"))).alias("arrivals_market_count"),
        F.count_distinct(F.when(F.col("forecast_count") > 0, F.col("market_id"))).alias("forecast_market_count"),
    ).withColumn("variety_examples", names)


def share_of_max(rollup: DataFrame) -> DataFrame:
    """Market count of each commodity against the largest; the roll-up has one row each."""
    largest = rollup.select(F.max("market_count")).scalar()
    return rollup.select(
        "commodity", "market_count", rounded(F.col("market_count") / largest, 4).alias("share_of_max")
    )


def commodity_freshness(rollup: DataFrame, end, threshold: int) -> DataFrame:
    age = F.greatest(F.datediff(end, "latest_date"), F.lit(0)).cast("long")
    return rollup.select("commodity", "latest_date", age.alias("age_days")).withColumn(
        "freshness", freshness(F.col("age_days"), threshold)
    )


# --- search ----------------------------------------------------------------

@dataclass(frozen=True)
class MarketFilter:
    text: str = ""
    state: str = ""
    district: str = ""
    commodity: str = ""
    market: str = ""
    variety: str = ""
    freshness: str = ""
    tier: str = ""
    since: date | None = None
    full_year: bool = False


def search(markets: DataFrame, wanted: MarketFilter, threshold: int) -> DataFrame:
    found = markets
    if wanted.text.strip():
        found = found.filter(mentions(
            wanted.text, F.col("market"), F.col("district"), F.col("state"), F.col("commodity"),
            within=F.col("varieties"),
        ))
    for column in ("state", "district", "commodity", "market"):
        if value := getattr(wanted, column):
            found = found.filter(F.col(column) == value)
    if wanted.variety:
        found = found.filter(F.array_contains("varieties", wanted.variety))
    if wanted.freshness:
        found = found.filter(freshness(F.col("latest_age_days"), threshold) == wanted.freshness)
    if wanted.tier:
        found = found.filter(F.col("coverage_tier") == wanted.tier)
    if wanted.since:
        found = found.filter(F.col("last_date") >= F.lit(wanted.since))
    if wanted.full_year:
        found = found.filter(F.datediff("last_date", "first_date") >= 365)
    return found


# Series keys end every order, so equal rows keep one place across runs.
SORTS = {
    "recent": [F.desc, "last_date", F.asc, "market"],
    "market": [F.asc, "market"],
    "price-low": [F.asc, "latest_price"],
    "price-high": [F.desc, "latest_price"],
}


def ordering(sort: str) -> list:
    spec = SORTS.get(sort, SORTS["recent"])
    return [make(column) for make, column in zip(spec[::2], spec[1::2])] + [F.asc("commodity"), F.asc("market_id")]


def page(markets: DataFrame, sort: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page, clamped to the last: a top-k per page, ranked only among the rows up to its end."""
    total = markets.count()
    last = max(1, -(-total // size))
    current = min(max(1, number), last)
    return markets.orderBy(*ordering(sort)).offset((current - 1) * size).limit(size)


def facets(markets: DataFrame, state: str = "", commodity: str = "") -> DataFrame:
    """Values still selectable under the current state and commodity, as (facet, value)."""
    in_state = (F.col("state") == state) if state else F.lit(True)
    in_crop = in_state & ((F.col("commodity") == commodity) if commodity else F.lit(True))
    offered = F.array(
        F.struct(F.lit("state").alias("facet"), F.col("state").alias("value"), F.lit(True).alias("on")),
        F.struct(F.lit("district").alias("facet"), F.col("district").alias("value"), in_state.alias("on")),
        F.struct(F.lit("commodity").alias("facet"), F.col("commodity").alias("value"), in_state.alias("on")),
        F.struct(F.lit("market").alias("facet"), F.col("market").alias("value"), in_crop.alias("on")),
    )
    return markets.select(F.inline(offered)).filter("on").select("facet", "value").distinct()


def market_detail(history: DataFrame, state: str, commodity: str, market_id: str) -> DataFrame:
    """One series, oldest first; the filters reach the partitions of the published folder."""
    return history.filter(
        (F.col("state") == state) & (F.col("commodity") == commodity) & (F.col("market_id") == market_id)
    ).orderBy("date")


def chart_points(history: DataFrame, points: int = 240) -> DataFrame:
    return S.systematic_sample(history, points, keep_anomalies=True).select(
        *S.SERIES, "date", F.col("min_price").alias("minimum"), F.col(S.PRICE).alias("representative"),
        F.col("max_price").alias("maximum"), F.col("arrivals_tonnes").alias("arrivals"),
        F.col("is_anomaly").alias("anomaly"),
    )


def arrival_points(history: DataFrame, points: int = 150) -> DataFrame:
    reported = history.filter(F.col("arrivals_tonnes").isNotNull())
    return S.systematic_sample(reported, points, keep_anomalies=True).select(*S.SERIES, "date", "arrivals_tonnes")


def band_positions(history: DataFrame) -> DataFrame:
    return history.select(
        *S.SERIES, "date",
        rounded(price_position(F.col("min_price"), F.col(S.PRICE), F.col("max_price")), 4).alias("band_position"),
    )


def first_page(markets: DataFrame, sort: str, size: int = PAGE_SIZE) -> DataFrame:
    """The first page under an order with the place of each row; only that page is numbered."""
    top = markets.orderBy(*ordering(sort)).limit(size)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*ordering(sort))))


def preview(markets: DataFrame, text: str = "", rows: int = 24) -> DataFrame:
    """The first matching rows in catalog order: a top-k."""
    found = markets
    if text:
        found = found.filter(mentions(text, F.col("market"), F.col("district"), F.col("state"), F.col("commodity")))
    return found.orderBy("state", "market", "commodity", "market_id").limit(rows)
