"""Registered queries: windows over a series, coverage, selection and refresh."""

from __future__ import annotations



from pyspark.sql import functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.operators import coverage as C
from bazaarflow.operators import series as S
from bazaarflow.operators import upsert as U
from bazaarflow.operators.publish import published_summary
from bazaarflow.plans import refresh
from bazaarflow.queries.base import (
    QUALITY, coverage, history, market_day_sql, oracle, published_coverage, register, rnd, scored,
    stored_history, stored_publication,
)
from bazaarflow.operators.market_day import market_days
from bazaarflow.session import write_and_reload
from bazaarflow.sources import tables as T

KEY = [*S.SERIES, "date"]
_S = "partition by commodity, market_id"


def latest_prices(spark, sf):
    """Newest price per market and commodity with its score, from validated reports."""
    days = refresh.accepted_history(T.defective_reports(spark, sf), T.LINE_POSITION, QUALITY)
    return S.latest_reports(S.with_anomaly(refresh.one_row_per_day(days))).select(
        "state", "market", *KEY, S.PRICE, "min_price", "max_price", "arrivals_tonnes", "anomaly_score", "is_anomaly"
    )


@register("latest_prices", oracle(f"""
  with days as (select * from accepted_days),
  prior as (select *, coalesce(list(representative_price) over ({_S} order by date rows between 30 preceding and 1 preceding), []) as e from days),
  ranked as (select *, list_median as c, greatest(1.4826 * list_aggregate(list_transform(e, lambda x: abs(x - list_median)), 'median'), list_median * 0.03, 1) as s
    from (select *, list_aggregate(e, 'median') as list_median from prior))
  select state, market, commodity, market_id, date, representative_price, min_price, max_price, arrivals_tonnes,
    {rnd('case when len(e) >= 8 then (representative_price - c) / s else 0 end', 4)} as anomaly_score,
    case when len(e) >= 8 then abs((representative_price - c) / s) >= 4 else false end as is_anomaly
  from ranked qualify row_number() over ({_S} order by date desc) = 1""", "accepted_days"))
def latest_prices_query(spark, sf):
    return latest_prices(spark, sf)


@register("anomaly_mad", oracle(f"select commodity, market_id, date, representative_price, anomaly_score, is_anomaly from scored", "scored"))
def anomaly_mad(spark, sf):
    return scored(spark, sf).select(*KEY, S.PRICE, "anomaly_score", "is_anomaly")


@register("report_gaps", oracle(f"""
  select commodity, market_id, date, date_diff('day', lag(date) over ({_S} order by date), date) as gap_days from history""", "history"))
def report_gaps(spark, sf):
    return history(spark, sf).select(*KEY, S.days_since_previous().alias("gap_days"))


@register("rolling_means", oracle(
    "select commodity, market_id, origin_date as date, "
    + ", ".join(f"{rnd(f'rolling_mean_{d}d', 4)} as rolling_mean_{d}d" for d in (7, 14, 30, 90)) + " from featured", "featured"))
def rolling_means(spark, sf):
    return history(spark, sf).select(
        *KEY, *(rounded(S.mean_of_last(d), 4).alias(f"rolling_mean_{d}d") for d in (7, 14, 30, 90))
    )


@register("rolling_stats_30d", oracle(f"""
  select commodity, market_id, origin_date as date, {rnd('rolling_median_30d', 4)} as median_30d,
    {rnd('rolling_std_30d', 4)} as std_30d, reports_30d from featured""", "featured"))
def rolling_stats_30d(spark, sf):
    values = S.values_of_last(30)
    measured = history(spark, sf).withColumn("_values", F.sort_array(values)).withColumn("_std", S.deviation_of_last(30))
    return measured.select(
        *KEY, rounded(S.median_of_sorted(F.col("_values")), 4).alias("median_30d"),
        rounded(F.col("_std"), 4).alias("std_30d"), F.size("_values").alias("reports_30d"),
    )


@register("asof_price", oracle("select commodity, market_id, origin_date as date, lag_7d as price_7d_ago from featured", "featured"))
def asof_price(spark, sf):
    return history(spark, sf).select(*KEY, S.asof(7).alias("price_7d_ago"))


@register("asof_lags", oracle("select commodity, market_id, origin_date as date, lag_1d, lag_7d, lag_14d, lag_28d from featured", "featured"))
def asof_lags(spark, sf):
    return history(spark, sf).select(*KEY, *(S.asof(d).alias(f"lag_{d}d") for d in (1, 7, 14, 28)))


@register("baseline_moving_average", oracle(f"""
  select commodity, market_id, origin_date as date, {rnd('baseline_moving_average', 4)} as moving_average from featured""", "featured"))
def baseline_moving_average(spark, sf):
    values = history(spark, sf).withColumn("_values", S.values_of_last(7))
    return values.select(*KEY, rounded(S.mean_of_latest(F.col("_values"), 5), 4).alias("moving_average"))


@register("origin_gate", oracle("""
  select commodity, market_id, origin_date as date, report_number from featured where report_number >= 9""", "featured"))
def origin_gate(spark, sf):
    return history(spark, sf).select(*KEY, S.report_number().alias("report_number")).filter("report_number >= 9")


@register("latest_per_series", oracle(f"""
  select * from history qualify row_number() over ({_S} order by date desc) = 1""", "history"))
def latest_per_series(spark, sf):
    return S.latest_reports(history(spark, sf))


@register("missing_days", oracle("""
  select commodity, market_id, count(*) as reports, greatest(date_diff('day', min(date), max(date)) + 1 - count(*), 0) as missing_days
  from history group by 1, 2""", "history"))
def missing_days(spark, sf):
    return S.missing_days(history(spark, sf))


@register("calendar_reported", oracle("""
  with ends as (select commodity, market_id, max(date) as last from history group by 1, 2),
  grid as (select commodity, market_id, last - cast(unnest(range(84)) as integer) as date from ends)
  select g.commodity, g.market_id, cast(g.date as date) as date, h.date is not null as reported
  from grid g left join history h on g.commodity = h.commodity and g.market_id = h.market_id and g.date = h.date""", "history"))
def calendar_reported(spark, sf):
    return S.calendar(stored_history(spark, sf), 84)


@register("series_varieties", oracle("""
  select commodity, market_id, string_agg(distinct example_variety, ',' order by example_variety) as varieties
  from history where example_variety <> '' group by 1, 2""", "history"))
def series_varieties(spark, sf):
    return S.varieties(history(spark, sf)).withColumn("varieties", F.array_join("varieties", ","))


_RANGES = {"d90": 90, "d365": 365, "d730": 730}


@register("history_range", oracle("\nunion all by name\n".join(
    f"select commodity, market_id, date, '{name}' as range from (select *, max(date) over ({_S}) as last from history) where date >= last - {days}"
    for name, days in _RANGES.items()) + "\nunion all by name\nselect commodity, market_id, date, 'all' as range from history", "history"))
def history_range(spark, sf):
    days = stored_history(spark, sf).select(*KEY)
    parts = [S.within_range(days, n).withColumn("range", F.lit(name)) for name, n in {**_RANGES, "all": None}.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


_SAMPLE = """
  select commodity, market_id, date, representative_price from (
    select *, row_number() over ({s} order by date) - 1 as i, count(*) over ({s}) as n from {source})
  where n <= {size} or i % cast(ceil(n / {size}) as bigint) = 0 or i = n - 1 {more}"""


@register("sample_history", oracle(_SAMPLE.format(s=_S, source="scored", size=240, more="or is_anomaly"), "scored"))
def sample_history(spark, sf):
    return S.systematic_sample(scored(spark, sf), 240, keep_anomalies=True).select(*KEY, S.PRICE)


_NEWEST = f"(select * from history qualify row_number() over ({_S} order by date desc) <= 120)"


@register("sparkline", oracle(_SAMPLE.format(s=_S, source=_NEWEST, size=18, more=""), "history"))
def sparkline(spark, sf):
    from bazaarflow.operators.explore import sparkline_points

    return sparkline_points(history(spark, sf))


# --- coverage and selection ------------------------------------------------

@register("coverage_series", oracle("select * from covered", "covered"))
def coverage_series(spark, sf):
    return coverage(spark, sf)


@register("repeated_price_share", oracle(f"""
  select commodity, market_id, cast(sum(n) as bigint) as record_count, {rnd('max(n) / sum(n)', 4)} as repeated_price_share
  from (select commodity, market_id, representative_price, count(*) as n from history group by 1, 2, 3) group by 1, 2""", "history"))
def repeated_price_share(spark, sf):
    return C.repeated_price_share(history(spark, sf))


@register("topn_selected", oracle("select * from selected", "selected"))
def topn_selected(spark, sf):
    return published_coverage(spark, sf)


@register("mark_selected", oracle("""
  select c.*, s.market_id is not null as selected from covered c left join selected s using (commodity, market_id)
  """, "covered", "selected"))
def mark_selected(spark, sf):
    return C.with_selected(write_and_reload(coverage(spark, sf), "coverage"), QUALITY.series_per_group)


@register("join_selected_semi", oracle("""
  select h.* from history h where exists (select 1 from selected s where s.commodity = h.commodity and s.market_id = h.market_id)""",
    "history", "selected"))
def join_selected_semi(spark, sf):
    days = stored_history(spark, sf)
    return C.restricted_to(days, C.selected_series(C.series_coverage(days, QUALITY), QUALITY.series_per_group))


@register("flt_rolling_history", oracle(f"""
  select * from history where date >= (select max(date) from history) - {QUALITY.history_days - 1}""", "history"))
def flt_rolling_history(spark, sf):
    return U.newest_days(stored_history(spark, sf), QUALITY.history_days)


@register("dev_sample", oracle(f"""
  with picked as (select commodity, market_id from covered qualify row_number() over (partition by commodity order by market, market_id) <= 2)
  select h.* from history h join picked using (commodity, market_id)
  qualify row_number() over (partition by h.commodity, h.market_id order by date desc) <= 120""", "covered", "history"))
def dev_sample(spark, sf):
    days = stored_history(spark, sf)
    return C.development_sample(days, C.series_coverage(days, QUALITY), 2, 120)


@register("published_summary", oracle(f"""
  select count(*) as records, count(distinct market_id) as markets, string_agg(distinct state, ',' order by state) as states,
    string_agg(distinct commodity, ',' order by commodity) as commodities, min(date) as date_min, max(date) as date_max,
    count(*) filter (where is_anomaly) as anomaly_records, count(*) filter (where district = 'Unknown') as missing_district_records,
    (select count(*) from selected) as series,
    (select count(*) from selected where latest_age_days > {QUALITY.stale_after_days}) as stale_series,
    (select count(*) from selected where maximum_gap_days > {QUALITY.long_gap_days}) as long_gap_series
  from published""", "published", "selected"))
def published_summary_query(spark, sf):
    return published_summary(*stored_publication(spark, sf), QUALITY)


# --- merge -----------------------------------------------------------------

def _batches(spark, sf):
    """Older lines as published history, newer returns as refresh; the days overlap."""
    reports = T.variety_reports(spark, sf)
    cut = F.lit("2000-06-01").cast("date")
    old_end = F.date_add(cut, 60)
    late = F.col("arrivals_tonnes").isNotNull() | (F.col("date") >= old_end)
    return market_days(reports.filter(F.col("date") < old_end)), market_days(
        reports.filter((F.col("date") >= cut) & late)
    )


_CUT, _OLD_END = "date '2000-06-01'", "date '2000-06-01' + 60"
_BATCHES = f"""
  old as ({market_day_sql(f"(select * from placed where date < {_OLD_END})")}),
  fresh as ({market_day_sql(f"(select * from placed where date >= {_CUT} and (arrivals_tonnes is not null or date >= {_OLD_END}))")}),
  merged as (select * from fresh union all by name
    select * from old o where not exists (select 1 from fresh f where f.market_id = o.market_id and f.commodity = o.commodity and f.date = o.date))"""


@register("upsert_keep_last", oracle(f"with {_BATCHES} select * from merged", "placed"))
def upsert_keep_last(spark, sf):
    return U.keep_last(*_batches(spark, sf))


@register("union_diagonal", oracle(f"""
  with {_BATCHES} select 'old' as batch, commodity, market_id, date, representative_price, cast(null as varchar) as arrival_coverage from old
  union all select 'fresh', commodity, market_id, date, representative_price, arrival_coverage from fresh""", "placed"))
def union_diagonal(spark, sf):
    old, fresh = _batches(spark, sf)
    kept = [*KEY, S.PRICE]
    return old.select(F.lit("old").alias("batch"), *kept).unionByName(
        fresh.select(F.lit("fresh").alias("batch"), *kept, "arrival_coverage"), allowMissingColumns=True
    )


def _score_sql(source):
    return f"""
      select * exclude (e, c, s), {rnd('case when len(e) >= 8 then (representative_price - c) / s else 0 end', 4)} as anomaly_score,
        case when len(e) >= 8 then abs((representative_price - c) / s) >= 4 else false end as is_anomaly
      from (select *, greatest(1.4826 * list_aggregate(list_transform(e, lambda x: abs(x - c)), 'median'), c * 0.03, 1) as s from (
        select *, list_aggregate(e, 'median') as c from (
          select *, coalesce(list(representative_price) over ({_S} order by date rows between 30 preceding and 1 preceding), []) as e from {source})))"""


@register("incremental_refresh", oracle(f"""
  with {_BATCHES},
  published as (select * from ({_score_sql('old')}) where date >= (select max(date) from old) - {QUALITY.history_days - 1}),
  joined as (select *, 1 as fresh, null::double as was_score, null::boolean as was_anomaly from fresh union all by name
    select * exclude (anomaly_score, is_anomaly), 0 as fresh, anomaly_score as was_score, is_anomaly as was_anomaly from published o
    where not exists (select 1 from fresh f where f.market_id = o.market_id and f.commodity = o.commodity and f.date = o.date)),
  again as (select *, max(fresh) over ({_S} order by date rows between 30 preceding and current row) as touched from ({_score_sql('joined')}))
  select * exclude (fresh, touched, was_score, was_anomaly) replace (
    case when touched = 1 then anomaly_score else was_score end as anomaly_score, case when touched = 1 then is_anomaly else was_anomaly end as is_anomaly)
  from again where date >= (select max(date) from joined) - {QUALITY.history_days - 1}""", "placed"))
def incremental_refresh(spark, sf):
    """Published rows are scored and trimmed before the refresh arrives, as in a second weekly run."""
    old, fresh = _batches(spark, sf)
    published = U.newest_days(S.with_anomaly(write_and_reload(old, "batch")), QUALITY.history_days)
    return refresh.merged_history(write_and_reload(published, "published"), write_and_reload(fresh, "batch"), QUALITY)


@register("check_unique", oracle("""
  select (select count(*) from (select 1 from history group by market_id, commodity, date having count(*) > 1)) as repeated_keys,
    count(*) as records from history""", "history"))
def check_unique(spark, sf):
    days = stored_history(spark, sf)
    repeats = U.repeated_keys(days).select(F.count("*")).scalar()
    return days.agg(F.count("*").alias("records")).withColumn("repeated_keys", repeats)
