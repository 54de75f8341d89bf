"""Registry of queries, their shared frames and the shared parts of their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.operators import coverage as C
from bazaarflow.operators.features import latest_target_date, training_rows, with_tier
from bazaarflow.operators import evaluate as E
from bazaarflow.operators import validate as V
from bazaarflow.operators.market_day import market_days
from bazaarflow.operators.series import with_anomaly
from bazaarflow.operators.upsert import newest_days
from bazaarflow.plans.outlook import tested_rows
from bazaarflow.session import write_and_reload
from bazaarflow.settings import DEFAULTS
from bazaarflow.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUALITY = replace(
    DEFAULTS.quality, start_date=date(1995, 2, 1), end_date=date(2001, 9, 30), maximum_price=50_000.0
)
MODEL = DEFAULTS.model


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


# --- shared frames ---------------------------------------------------------

def checked(spark, folder) -> DataFrame:
    return V.validated(
        T.defective_reports(spark, folder), QUALITY.start_date, QUALITY.end_date, QUALITY.maximum_price
    )


def marked(spark, folder) -> DataFrame:
    return V.with_duplicates_marked(checked(spark, folder), T.LINE_POSITION)


def history(spark, folder) -> DataFrame:
    return market_days(T.variety_reports(spark, folder))


def stored_history(spark, folder) -> DataFrame:
    """Market-days written once, for queries that read them several times.

    The reports are scanned and rolled up in one pass; what follows reads the small table.
    """
    return write_and_reload(history(spark, folder), "history")


def scored(spark, folder) -> DataFrame:
    return with_anomaly(history(spark, folder))


def coverage(spark, folder) -> DataFrame:
    return C.series_coverage(stored_history(spark, folder), QUALITY)


def tiered(spark, folder) -> DataFrame:
    days = stored_history(spark, folder)
    return with_tier(days, C.series_coverage(days, QUALITY))


def training(spark, folder) -> DataFrame:
    return training_rows(tiered(spark, folder), MODEL)


def folded(spark, folder) -> DataFrame:
    days = tiered(spark, folder)
    return E.with_folds(training_rows(days, MODEL), latest_target_date(days, MODEL), MODEL)


def wide(spark, folder) -> DataFrame:
    return tested_rows(write_and_reload(tiered(spark, folder), "tiered"), MODEL)


def long(spark, folder) -> DataFrame:
    return E.long_predictions(wide(spark, folder))


def stored_wide(spark, folder) -> DataFrame:
    """Fold and holdout predictions written once, for calibration and scoring."""
    return write_and_reload(wide(spark, folder), "predictions")


def published_coverage(spark, folder) -> DataFrame:
    return C.selected_series(coverage(spark, folder), QUALITY.series_per_group)


def publication(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Published history and coverage from one stored history."""
    days = stored_history(spark, folder)
    selected = C.selected_series(C.series_coverage(days, QUALITY), QUALITY.series_per_group)
    recent = newest_days(with_anomaly(days), QUALITY.history_days)
    return C.restricted_to(recent, selected), selected


def published(spark, folder) -> DataFrame:
    return publication(spark, folder)[0]


def stored_publication(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Both written once, for queries that read them several times."""
    days, selected = publication(spark, folder)
    return write_and_reload(days, "published"), write_and_reload(selected, "coverage")


# --- SQL parts -------------------------------------------------------------

def rnd(value: str, digits: int) -> str:
    return f"cast(round(cast({value} as decimal(18,6)), {digits}) as double)"


def market_day_sql(source: str) -> str:
    weighable = "count(arrivals_tonnes) = count(*) and sum(arrivals_tonnes) > 0"
    price = (
        f"case when {weighable} then sum(modal_price * arrivals_tonnes) / sum(arrivals_tonnes) "
        "else median(modal_price) end"
    )
    return f"""
      select state_id, state, district, market_id, market, commodity, date,
        {rnd('min(min_price)', 2)} as min_price, {rnd('max(max_price)', 2)} as max_price,
        {rnd(price, 2)} as representative_price,
        {rnd('sum(arrivals_tonnes)', 3)} as arrivals_tonnes,
        count(distinct variety) as variety_count,
        first(variety order by coalesce(arrivals_tonnes, -1) desc, variety) as example_variety,
        case when count(arrivals_tonnes) > 0 then 'largest reported arrivals'
             else 'alphabetical fallback' end as example_variety_basis,
        case when {weighable} then 'arrival-weighted mean of variety modal prices'
             else 'median of variety modal prices' end as aggregation_method,
        case when count(arrivals_tonnes) = count(*) then 'complete'
             when count(arrivals_tonnes) > 0 then 'partial' else 'missing' end as arrival_coverage
      from {source} group by 1, 2, 3, 4, 5, 6, 7"""


_SERIES = "partition by commodity, market_id"
_BACK = lambda d: f"({_SERIES} order by date range between interval {d} days preceding and current row)"
_ASOF = lambda d: (
    f"coalesce(last_value(representative_price) over ({_SERIES} order by date range between unbounded "
    f"preceding and interval {d} days preceding), first_value(representative_price) over ({_SERIES} order by date))"
)
METRICS_SQL = f"""
  count(*) as n, {rnd('avg(abs(actual - prediction))', 2)} as mae,
  {rnd('sum(abs(actual - prediction)) / greatest(sum(abs(actual)), 1)', 4)} as wape,
  {rnd('avg(2 * abs(actual - prediction) / greatest(abs(actual) + abs(prediction), 1))', 4)} as smape,
  {rnd('avg(case when sign(prediction - current_price) = sign(actual - current_price) then 1.0 else 0.0 end)', 4)}
    as directional_accuracy"""
VOLATILITY_SQL = lambda v: f"case when {v} < 0.08 then 'stable' when {v} < 0.2 then 'variable' else 'volatile' end"
FRESH_SQL = lambda v, t: f"case when {v} <= 2 then 'fresh' when {v} <= {t} then 'recent' else 'stale' end"
SLUG_SQL = lambda v: (
    f"trim(regexp_replace(translate(replace(lower({v}), 'ß', 'ss'), 'ς', 'σ'), '[^a-z0-9]+', '-', 'g'), '-')"
)

# name -> (SQL, names it needs)
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "placed": (f"""
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_discount, l_tax,
        cast(r_regionkey as bigint) as state_id, r_name as state, n_name as district,
        r_regionkey || '-' || n_nationkey as market_id, n_name as market,
        p_type as commodity, p_brand as variety, cast(l_shipdate as date) as date, modal_price,
        {rnd('modal_price * (1 - l_discount)', 2)} as min_price,
        {rnd('modal_price * (1 + l_tax)', 2)} as max_price,
        case when l_returnflag <> 'R' then l_quantity end as arrivals_tonnes
      from (select *, {rnd('l_extendedprice / l_quantity', 2)} as modal_price from lineitem)
      join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
      join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""", ()),
    "defective": ("""
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, state_id, state, district,
        market_id, case when l_linenumber = 3 and l_tax < 0.005 then '' else market end as market,
        commodity, variety, date,
        case when l_linenumber = 4 and l_tax < 0.005 and l_discount < 0.005 then 0.0
             when l_linenumber = 7 then max_price else min_price end as min_price,
        case when l_linenumber = 7 then min_price else max_price end as max_price,
        case when l_linenumber = 6 and l_tax > 0.075 then null else modal_price end as modal_price,
        case when l_linenumber = 5 and l_discount > 0.095 then -arrivals_tonnes
             else arrivals_tonnes end as arrivals_tonnes,
        strftime(date, '%Y-%m') as source_month,
        unnest(case when l_orderkey % 50 = 0 then [0, 1] else [0] end) as copy
      from placed""", ("placed",)),
    "checked": (f"""
      select *, lower(variety) as variety_key, case
        when market is null or market = '' or date is null then 'missing_identity_or_invalid_date'
        when date < date '{QUALITY.start_date}' or date > date '{QUALITY.end_date}' then 'outside_requested_date_range'
        when min_price is null or max_price is null or modal_price is null then 'unparseable_price'
        when min_price <= 0 or max_price <= 0 or modal_price <= 0 then 'non_positive_price'
        when greatest(min_price, max_price, modal_price) > {QUALITY.maximum_price} then 'price_above_safety_ceiling'
        when not (min_price <= modal_price and modal_price <= max_price) then 'invalid_price_order'
        when arrivals_tonnes < 0 then 'negative_arrivals' end as first_reason
      from defective""", ("defective",)),
    "marked": ("""
      select *, case when first_reason is null and row_number() over (
          partition by first_reason is null, market_id, commodity, variety_key, date, min_price, max_price, modal_price
          order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, copy) > 1
        then 'exact_duplicate' else first_reason end as exclusion_reason
      from checked""", ("checked",)),
    "accepted": ("select * from marked where exclusion_reason is null", ("marked",)),
    "accepted_days": (market_day_sql("accepted"), ("accepted",)),
    "history": (market_day_sql("placed"), ("placed",)),
    "scored": (f"""
      select * exclude (earlier, center, spread, scale),
        {rnd('case when len(earlier) >= 8 then (representative_price - center) / scale else 0 end', 4)} as anomaly_score,
        case when len(earlier) >= 8 then abs((representative_price - center) / scale) >= 4 else false end as is_anomaly
      from (
        select *, greatest(1.4826 * spread, center * 0.03, 1.0) as scale from (
          select *, list_aggregate(list_transform(earlier, lambda x: abs(x - center)), 'median') as spread from (
            select *, median(representative_price) over w as center,
              coalesce(list(representative_price) over w, []) as earlier
            from history
            window w as ({_SERIES} order by date rows between 30 preceding and 1 preceding))))""", ("history",)),
    "measured": (f"""
      select *, date_diff('day', lag(date) over ({_SERIES} order by date), date) as gap,
        count(*) over (partition by commodity, market_id, representative_price) as repeats
      from history
      where date >= (select max(date) from history) - {QUALITY.coverage_window_days - 1}""", ("history",)),
    "covered": (f"""
      select *, record_count >= {QUALITY.minimum_records} and weekly_coverage >= {QUALITY.minimum_weekly_coverage}
          and latest_age_days <= {QUALITY.maximum_age_days} as eligible,
        case when weekly_coverage >= 0.75 then 'high' else 'standard' end as coverage_tier
      from (
        select arg_min(state_id, date) as state_id, arg_min(state, date) as state, commodity, market_id,
          arg_min(market, date) as market, arg_min(district, date) as district,
          min(date) as first_date, max(date) as last_date, count(*) as record_count,
          count(distinct strftime(date, '%G-%V')) as weeks_reported,
          {rnd("count(distinct strftime(date, '%G-%V')) / greatest(date_diff('day', date_trunc('week', min(date)), date_trunc('week', max(date))) // 7 + 1, 1)", 4)} as weekly_coverage,
          date_diff('day', max(date), (select max(date) from history)) as latest_age_days,
          coalesce(max(gap), 0) as maximum_gap_days,
          {rnd('coalesce(stddev_samp(representative_price), 0) / nullif(avg(representative_price), 0)', 4)} as price_cv,
          {rnd('max(repeats) / count(*)', 4)} as repeated_price_share
        from measured group by commodity, market_id)""", ("measured",)),
    "selected": (f"""
      select * from (select *, row_number() over (partition by state_id, commodity order by weekly_coverage desc,
        record_count desc, latest_age_days, market_id) as selection_rank from covered where eligible)
      where selection_rank <= {QUALITY.series_per_group}""", ("covered",)),
    "published": (f"""
      select * from scored s
      where date >= (select max(date) from scored) - {QUALITY.history_days - 1}
        and exists (select 1 from selected c where c.commodity = s.commodity and c.market_id = s.market_id)""",
                  ("scored", "selected")),
    "tiered": ("""
      select h.*, coalesce(c.coverage_tier, 'standard') as coverage_tier
      from history h left join covered c using (commodity, market_id)""", ("history", "covered")),
    "featured": ("", ("tiered",)),
    "training": (f"""
      select f.*, h.date as target_date, h.representative_price as target,
        date_diff('day', f.origin_date, h.date) as lead_days, date_diff('day', f.origin_date, h.date) as target_offset_days,
        0 as data_age_days, isodow(h.date) - 1 as target_weekday, weekofyear(h.date) as target_week, month(h.date) as target_month
      from featured f join history h on f.commodity = h.commodity and f.market_id = h.market_id
        and h.date > f.origin_date and h.date <= f.origin_date + {MODEL.maximum_lead_days}
      where f.report_number >= {MODEL.minimum_reports}""", ("featured", "history")),
    "folded": (f"""
      select *, case when before <= 0 then 'locked_holdout' when before <= {MODEL.folds * MODEL.fold_days} then 'model_selection'
          else 'earlier' end as phase,
        case when before <= 0 then -1
             when before <= {MODEL.fold_days} then 2 when before <= {2 * MODEL.fold_days} then 1
             when before <= {3 * MODEL.fold_days} then 0 end as fold_index
      from (select *, date_diff('day', target_date, (select max(target_date) from training) - {MODEL.holdout_days - 1}) as before
            from training)""", ("training",)),
    "wide": ("""
      select phase, fold_index, state, commodity, market, market_id, coverage_tier, volatility_bucket, lead_days,
        target_date, target as actual, current_price, rolling_mean_7d, baseline_last as last_observation,
        baseline_moving_average as moving_average, baseline_seasonal_naive as seasonal_naive
      from folded where phase <> 'earlier'""", ("folded",)),
    "predictions": ("""
      select * exclude (last_observation, moving_average, seasonal_naive), 'last_observation' as method, last_observation as prediction from wide
      union all by name
      select * exclude (last_observation, moving_average, seasonal_naive), 'moving_average' as method, moving_average as prediction from wide
      union all by name
      select * exclude (last_observation, moving_average, seasonal_naive), 'seasonal_naive' as method, seasonal_naive as prediction from wide""",
                    ("wide",)),
}


def featured_sql(source: str) -> str:
    back = _BACK
    return f"""
      select date as origin_date, state, commodity, market_id, market, district, coverage_tier,
        {VOLATILITY_SQL('deviation / greatest(rolling_mean_30d, 1)')} as volatility_bucket, arrival_coverage,
        representative_price as current_price, min_price as current_min_price, max_price as current_max_price,
        coalesce(arrivals_tonnes, 0) as current_arrivals,
        cast(arrivals_tonnes is null as double) as current_arrivals_missing,
        lag_1d, lag_7d, lag_14d, lag_28d, rolling_mean_7d, rolling_mean_14d, rolling_mean_30d, rolling_mean_90d,
        rolling_median_30d, deviation as rolling_std_30d, deviation / greatest(rolling_mean_30d, 1) as relative_volatility_30d,
        representative_price - lag_7d as momentum_7d, max_price - min_price as current_spread,
        reporting_gap_days, reports_30d, representative_price as baseline_last,
        list_aggregate(values_7d[greatest(len(values_7d) - 4, 1):], 'avg') as baseline_moving_average,
        lag_7d as baseline_seasonal_naive, report_number, series_size
      from (select *,
        {_ASOF(1)} as lag_1d, {_ASOF(7)} as lag_7d, {_ASOF(14)} as lag_14d, {_ASOF(28)} as lag_28d,
        avg(representative_price) over {back(7)} as rolling_mean_7d,
        avg(representative_price) over {back(14)} as rolling_mean_14d,
        avg(representative_price) over {back(30)} as rolling_mean_30d,
        avg(representative_price) over {back(90)} as rolling_mean_90d,
        median(representative_price) over {back(30)} as rolling_median_30d,
        coalesce(stddev_samp(representative_price) over {back(30)}, 0) as deviation,
        count(*) over {back(30)} as reports_30d,
        list(representative_price order by date) over {back(7)} as values_7d,
        date_diff('day', lag(date) over ({_SERIES} order by date), date) as reporting_gap_days,
        row_number() over ({_SERIES} order by date) as report_number,
        count(*) over ({_SERIES}) as series_size
        from {source})"""


PARTS["featured"] = (featured_sql("tiered"), ("tiered",))


def oracle(final: str, *needs: str) -> str:
    """The final SELECT with the shared parts it needs in front, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in PARTS[name][1]:
            visit(need)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return final.strip()
    body = ",\n".join(f"{name} as ({PARTS[name][0]})" for name in order)
    final = final.strip()
    rest = f",\n{final[5:]}" if final.startswith("with ") else f"\n{final}"
    return f"with {body}{rest}"
