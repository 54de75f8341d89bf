"""Registered queries: forecast table, publishing, roll-ups and the explorer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.operators import coverage as C
from bazaarflow.operators import explore as X
from bazaarflow.operators import files as H
from bazaarflow.operators import forecast as P
from bazaarflow.operators import publish as B
from bazaarflow.operators import series as S
from bazaarflow.operators import store as K
from bazaarflow.operators.features import forecast_rows, with_tier
from bazaarflow.operators.upsert import newest_days
from bazaarflow.plans import evidence as E
from bazaarflow.plans.outlook import baseline_forecasts
from bazaarflow.queries.base import (
    FRESH_SQL, MODEL, PARTS, QUALITY, SLUG_SQL, coverage, featured_sql, history, oracle, publication, published,
    published_coverage, register, rnd, scored, stored_history, stored_publication,
)
from bazaarflow.queries.evaluation import fallback_sql
from bazaarflow.queries.features import FORECAST_SQL
from bazaarflow.queries.reports import LEDGER_SQL as _LEDGER_SQL
from bazaarflow.session import write_and_reload
from bazaarflow.settings import Settings
from bazaarflow.sources import tables as T

SETTINGS = Settings(quality=replace(QUALITY, maximum_price=250_000.0), model=MODEL)
METHOD, COLUMN = "moving_average", "baseline_moving_average"
THRESHOLD = QUALITY.stale_after_days
_S = "partition by commodity, market_id"

# Forecasts need the published history three times, so the SQL parts are built on it as well.
PARTS["p_tiered"] = ("select h.*, c.coverage_tier from published h join selected c using (commodity, market_id)", ("published", "selected"))
PARTS["p_featured"] = (featured_sql("p_tiered"), ("p_tiered",))
PARTS["p_training"] = (PARTS["training"][0].replace("from featured f join history h", "from p_featured f join published h"), ("p_featured", "published"))
PARTS["p_folded"] = (PARTS["folded"][0].replace("from training", "from p_training"), ("p_training",))
PARTS["p_quantiles"] = ("\nunion all\n".join(
    f"""select '{level}' as level, {key} as interval_key, quantile_cont(target - {COLUMN}, 0.1) as lower_residual,
      quantile_cont(target - {COLUMN}, 0.9) as upper_residual, count(*) as n
    from p_folded where phase <> 'earlier' group by 1, 2 having count(*) >= {MODEL.interval_minimum_samples.get(level, 0)}"""
    for level, key in {
        "market": "'market|' || market_id || '|' || lead_days || '|' || volatility_bucket",
        "state_crop": "'state_crop|' || state || '|' || commodity || '|' || lead_days || '|' || volatility_bucket",
        "crop": "'crop|' || commodity || '|' || lead_days", "lead": "'lead|' || lead_days", "__global__": "'__global__'",
    }.items()), ("p_folded",))
PARTS["quantiles"] = ("select * from p_quantiles", ("p_quantiles",))
PARTS["p_rows"] = (f"select *, least(greatest({COLUMN}, 1), 250000) as prediction from ({FORECAST_SQL.format(history='published', featured='p_featured')})", ("p_featured", "published"))
PARTS["p_bounded"] = (fallback_sql("p_rows", "prediction"), ("p_rows", "quantiles"))
PARTS["forecasts"] = (f"""
  select state, commodity, market_id, market, district, comparison_date, origin_date as observed_date, target_date as forecast_date,
    cast(target_offset_days as bigint) as target_offset_days, lead_days,
    {rnd('current_min_price', 2)} as current_min_price, {rnd('current_price', 2)} as current_representative_price,
    {rnd('current_max_price', 2)} as current_max_price,
    case when current_arrivals_missing <> 1 then {rnd('current_arrivals', 3)} end as current_arrivals_tonnes, arrival_coverage,
    {rnd('prediction', 2)} as forecast_price, {rnd('lower', 2)} as forecast_low, {rnd('upper', 2)} as forecast_high,
    {rnd('(upper - lower) / greatest(prediction, 1)', 4)} as interval_width_pct,
    (upper - lower) / greatest(prediction, 1) >= 0.35 as wide_interval,
    interval_level as interval_calibration_level, calibration_n as interval_calibration_samples,
    {rnd('momentum_7d / greatest(lag_7d, 1)', 4)} as recent_change_pct,
    {rnd('(current_price - greatest(rolling_mean_90d, 1)) / greatest(rolling_mean_90d, 1)', 4)} as seasonal_position_pct,
    {rnd('relative_volatility_30d', 4)} as relative_volatility_30d, volatility_bucket, data_age_days as freshness_days,
    coverage_tier, '{METHOD}' as method
  from p_bounded""", ("p_bounded",))
PARTS["sparkpoints"] = (f"""
  select commodity, market_id, date, representative_price from (
    select *, row_number() over ({_S} order by date) - 1 as i, count(*) over ({_S}) as n
    from (select * from published qualify row_number() over ({_S} order by date desc) <= 120))
  where n <= 18 or i % cast(ceil(n / 18) as bigint) = 0 or i = n - 1""", ("published",))
PARTS["markets"] = (f"""
  select c.*, l.date as latest_date, l.representative_price as latest_price, v.varieties, v.has_arrivals,
    {SLUG_SQL('c.state')} as state_slug, {SLUG_SQL('c.commodity')} as commodity_slug,
    {SLUG_SQL('c.state')} || '/' || {SLUG_SQL('c.commodity')} || '/' || c.market_id as key
  from selected c join (select * from published qualify row_number() over ({_S} order by date desc) = 1) l using (commodity, market_id)
  join (select commodity, market_id, list_sort(list(distinct example_variety) filter (where example_variety <> '')) as varieties,
      count(arrivals_tonnes) > 0 as has_arrivals from published group by 1, 2) v using (commodity, market_id)""", ("published", "selected"))


def forecasts(spark, sf, stored=None):
    days, covered = stored or stored_publication(spark, sf)
    return baseline_forecasts(days, covered, METHOD, SETTINGS)


def markets(spark, sf):
    """Catalog rows without forecasts, with the latest price as a column."""
    days, covered = publication(spark, sf)
    per_series = days.groupBy(*S.SERIES).agg(
        F.max("date").alias("latest_date"), F.max_by(S.PRICE, "date").alias("latest_price"),
        F.array_sort(F.collect_set(F.nullif("example_variety", F.lit("")))).alias("varieties"),
        (F.count("arrivals_tonnes") > 0).alias("has_arrivals"),
    )
    return covered.join(per_series, list(S.SERIES))


# --- forecasts -------------------------------------------------------------

@register("forecast_point", oracle(f"""
  select commodity, market_id, target_offset_days, {rnd('prediction', 4)} as prediction from p_rows""", "p_rows"))
def forecast_point(spark, sf):
    days = with_tier(*stored_publication(spark, sf))
    return forecast_rows(days, MODEL).select(
        *S.SERIES, "target_offset_days", rounded(P.point(METHOD, 250_000.0), 4).alias("prediction")
    )


@register("forecast_table", oracle("select * from forecasts", "forecasts"))
def forecast_table(spark, sf):
    return forecasts(spark, sf)


@register("forecast_change", oracle(f"""
  select commodity, market_id, target_offset_days,
    {rnd('(forecast_price - current_representative_price) / greatest(current_representative_price, 1)', 4)} as change_pct from forecasts""", "forecasts"))
def forecast_change(spark, sf):
    return P.change_against_current(forecasts(spark, sf)).select(*S.SERIES, "target_offset_days", "change_pct")


@register("flat_outlook", oracle("""
  select commodity, market_id, count(*) as n, count(*) > 1 and count(distinct forecast_price) = 1 as flat_outlook from forecasts group by 1, 2""", "forecasts"))
def flat_outlook(spark, sf):
    return P.flat_outlook(forecasts(spark, sf))


@register("check_common_date", oracle("select distinct comparison_date from p_rows", "p_rows"))
def check_common_date(spark, sf):
    return P.common_comparison_date(forecasts(spark, sf))


# --- publishing ------------------------------------------------------------

@register("seasonal_median", oracle(f"""
  select state, commodity, market_id, month(date) as month, {rnd('median(representative_price)', 2)} as median_price, count(*) as observations
  from published group by 1, 2, 3, 4""", "published"))
def seasonal_median(spark, sf):
    return B.seasonal(published(spark, sf))


_STATS_SQL = f"""
  stats as (select c.state, c.commodity, {SLUG_SQL('c.state')} as state_slug, {SLUG_SQL('c.commodity')} as commodity_slug, market_count,
    coalesce(observation_count, 0) as observation_count, coalesce(forecast_count, 0) as forecast_count, date_min, date_max
  from (select state, commodity, count(*) as market_count from selected group by 1, 2) c
  left join (select state, commodity, count(*) as observation_count, min(date) as date_min, max(date) as date_max from published group by 1, 2) h using (state, commodity)
  left join (select state, commodity, count(*) as forecast_count from p_rows group by 1, 2) f using (state, commodity))"""


@register("partition_stats", oracle(f"with {_STATS_SQL} select *, '/data/' || state_slug || '/' || commodity_slug || '.json' as url from stats", "selected", "published", "p_rows"))
def partition_stats(spark, sf):
    stored = stored_publication(spark, sf)
    return B.partition_stats(*stored, forecast_rows(with_tier(*stored), MODEL))


@register("pub_manifest_totals", oracle("""
  select count(*) as observed_records, min(date) as date_min, max(date) as date_max, (select count(*) from selected) as series,
    (select count(distinct market_id) from selected) as markets, (select string_agg(distinct state, ',' order by state) from selected) as states,
    (select string_agg(distinct commodity, ',' order by commodity) from selected) as commodities,
    (select count(*) from p_rows) as forecast_records, (select max(comparison_date) from p_rows) as comparison_date
  from published""", "published", "selected", "p_rows"))
def pub_manifest_totals(spark, sf):
    stored = stored_publication(spark, sf)
    return B.manifest_totals(*stored, forecast_rows(with_tier(*stored), MODEL))


@register("pub_partition_json", oracle(f"""
  select state, commodity, market_id, {SLUG_SQL('state')} as state_slug, {SLUG_SQL('commodity')} as commodity_slug, kind, day, price from (
    select state, commodity, market_id, 'market' as kind, last_date as day, price_cv as price from selected
    union all select state, commodity, market_id, 'observation', date, representative_price from published
    union all select state, commodity, market_id, 'forecast', forecast_date, forecast_price from forecasts
    union all select state, commodity, market_id, 'seasonal', null, {rnd('median(representative_price)', 2)} from published group by state, commodity, market_id, month(date))""",
    "selected", "published", "forecasts"))
def pub_partition_json(spark, sf):
    """Published records, written as partitioned JSON and read back through the record text."""
    from bazaarflow.session import shared_folder

    stored = stored_publication(spark, sf)
    rows = B.published_rows(*stored, forecasts(spark, sf, stored))
    folder = shared_folder(spark, "published-json")
    B.write_published(rows, folder)
    back = spark.read.schema(rows.schema).json(folder)
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return back.select(
        "state", "commodity", "market_id", "state_slug", "commodity_slug", "kind",
        F.coalesce(field("last_date"), field("date"), field("forecast_date")).cast("date").alias("day"),
        F.coalesce(field("price_cv"), field("representative_price"), field("forecast_price"), field("median_price")).cast("double").alias("price"),
    )


@register("pub_stale_partitions", oracle("""
  select distinct state, commodity from history where not exists
    (select 1 from selected s where s.state = history.state and s.commodity = history.commodity and s.market_id like '%-1%')""", "history", "selected"))
def pub_stale_partitions(spark, sf):
    """Partitions of an earlier publication that covered every series, against a narrower one."""
    days = stored_history(spark, sf)
    selected = C.selected_series(C.series_coverage(days, QUALITY), QUALITY.series_per_group)
    expected = selected.filter(F.col("market_id").contains("-1")).select("state", "commodity").distinct()
    return B.stale_partitions(days, expected)


_LINES, _RANGE = 100, 65_536
_FILE_SQL = f"""
  with files as (select doc_id // {_LINES} as batch, encode(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as content from documents group by 1),
  ranges as (select batch, octet_length(content) as bytes, i,
      sha256(unhex(substr(hex(content), 2 * {_RANGE} * i + 1, 2 * {_RANGE}))) as digest
    from files, lateral (select unnest(range(0, greatest(1, cast(ceil(octet_length(content) / {_RANGE}) as bigint)))) as i))"""


@register("pub_file_ledger", oracle(f"""{_FILE_SQL}
  select batch, any_value(bytes) as bytes, count(*) as ranges,
    case when count(*) = 1 then any_value(digest) else sha256(string_agg(digest, '' order by i)) end as sha256
  from ranges group by batch"""))
def pub_file_ledger(spark, sf):
    """Documents written as text files of a hundred each, sorted by id; size and hash of every file, read in ranges."""
    from bazaarflow.session import shared_folder

    folder = shared_folder(spark, "document-files")
    docs = T.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / _LINES).alias("batch"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # rows of a batch meet in one task, in order, and make one file
    dealt = docs.repartition("batch").sortWithinPartitions("batch", "doc_id")
    dealt.select("batch", "text").write.partitionBy("batch").text(folder)
    ledger = H.file_ledger(spark, folder, "*.txt", _RANGE)
    batch = F.regexp_extract("path", r"/batch=([0-9]+)/", 1).cast("long")
    return ledger.select(batch.alias("batch"), "bytes", "ranges", "sha256")


@register("pub_folder_ledger", oracle(f"""{_FILE_SQL},
  files_ as (select batch, any_value(bytes) as bytes, case when count(*) = 1 then any_value(digest) else sha256(string_agg(digest, '' order by i)) end as sha256
    from ranges group by batch),
  named as (select lpad((batch // 10)::varchar, 6, '0') as folder, lpad(batch::varchar, 8, '0') as name, bytes, sha256 from files_),
  bins as (select folder, sha256(name)[1:2] as bin, sum(bytes) as bytes, count(*) as files, sha256(string_agg(name || ':' || sha256, chr(10) order by name)) as digest
    from named group by 1, 2)
  select folder, cast(sum(bytes) as bigint) as bytes, cast(sum(files) as bigint) as files, sha256(string_agg(digest, '' order by bin)) as sha256 from bins group by 1"""))
def pub_folder_ledger(spark, sf):
    """Bytes and hash of folders, here of ten files each, from the ledger of their files."""
    ledger = write_and_reload(pub_file_ledger(spark, sf), "ledger")
    padded = lambda c, n: F.lpad(c.cast("string"), n, "0")
    named = ledger.select(padded(F.floor(F.col("batch") / 10), 6).alias("folder"), padded(F.col("batch"), 8).alias("name"), "bytes", "sha256")
    return H.folder_ledger(named)


_CROPS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@register("pivot_coverage", oracle("select state, " + ", ".join(
    f"nullif(count(*) filter (where commodity = '{c}'), 0) as \"{c}\"" for c in _CROPS) + " from covered group by state", "covered"))
def pivot_coverage(spark, sf):
    return B.coverage_matrix(coverage(spark, sf), list(_CROPS))


# --- catalog ---------------------------------------------------------------

@register("catalog_markets", oracle(f"""
  select key, '/markets/' || key as route, state, commodity, market_id, market, district, latest_date, latest_price, has_arrivals,
    array_to_string(varieties, ',') as varieties,
    (select string_agg(strftime(p.date, '%Y-%m-%d') || '=' || cast(p.representative_price as decimal(18,2)), ',' order by p.date)
       from sparkpoints p where p.commodity = m.commodity and p.market_id = m.market_id) as sparkline,
    (select count(*) from p_rows r where r.commodity = m.commodity and r.market_id = m.market_id) as forecast_count
  from markets m""", "markets", "sparkpoints", "p_rows"))
def catalog_markets(spark, sf):
    stored = stored_publication(spark, sf)
    built = X.catalog(stored[1], stored[0], forecasts(spark, sf, stored))
    point = lambda p: F.concat(F.date_format(p["date"], "yyyy-MM-dd"), F.lit("="), p["value"].cast("decimal(18,2)").cast("string"))
    return built.select(
        "key", "route", "state", "commodity", "market_id", "market", "district",
        F.col("latest.date").alias("latest_date"), F.col(f"latest.{S.PRICE}").alias("latest_price"), "has_arrivals",
        F.array_join("varieties", ",").alias("varieties"),
        F.array_join(F.transform("sparkline", point), ",").alias("sparkline"),
        F.col("forecast_count").cast("long").alias("forecast_count"),
    )


_FRESH = lambda name: f"count(*) filter (where {FRESH_SQL('latest_age_days', THRESHOLD)} = '{name}') as {name}_series"


@register("state_rollup", oracle(f"""
  select state, count(distinct commodity) as commodity_count, count(distinct market_id) as market_count, count(distinct district) as district_count,
    count(*) as series_count, max(last_date) as latest_date, {_FRESH('fresh')}, {_FRESH('recent')}, {_FRESH('stale')},
    (select count(*) from published p where p.state = s.state) as observation_count
  from selected s group by state""", "selected", "published"))
def state_rollup(spark, sf):
    days, covered = publication(spark, sf)
    return X.state_rollup(covered, days, THRESHOLD)


_COMMODITY_SQL = f"""select commodity, count(distinct market_id) as market_count, count(*) as series_count, max(last_date) as latest_date,
    min(latest_price) as latest_min, max(latest_price) as latest_max, {_FRESH('fresh')} from markets group by 1"""


@register("commodity_rollup", oracle(_COMMODITY_SQL, "markets"))
def commodity_rollup(spark, sf):
    return X.commodity_rollup(markets(spark, sf), THRESHOLD)


@register("upper_median_by_date", oracle("""
  select commodity, date, list_sort(list(representative_price))[len(list(representative_price)) // 2 + 1] as value from sparkpoints group by 1, 2""", "sparkpoints"))
def upper_median_by_date(spark, sf):
    return X.upper_median_by_date(X.sparkline_points(published(spark, sf)))


@register("commodity_sparkline", oracle("""
  with pooled as (select commodity, date, list_sort(list(representative_price))[len(list(representative_price)) // 2 + 1] as value from sparkpoints group by 1, 2),
  recent as (select * from pooled qualify row_number() over (partition by commodity order by date desc) <= 90)
  select commodity, date, value from (select *, row_number() over (partition by commodity order by date) - 1 as i, count(*) over (partition by commodity) as n from recent)
  where n <= 24 or i % cast(ceil(n / 24) as bigint) = 0 or i = n - 1""", "sparkpoints"))
def commodity_sparkline(spark, sf):
    return X.commodity_sparkline(X.sparkline_points(published(spark, sf)))


@register("catalog_totals", oracle("""
  select count(distinct district) as districts, string_agg(distinct district, ',' order by district) as district_names,
    (select string_agg(distinct example_variety, ',' order by example_variety) from published where example_variety <> '') as variety_examples,
    count(distinct market_id) filter (where has_arrivals) as arrivals_market_count,
    (select count(distinct market_id) from p_rows) as forecast_market_count
  from markets""", "markets", "p_rows"))
def catalog_totals(spark, sf):
    days, covered = stored_publication(spark, sf)
    outlook = forecast_rows(with_tier(days, covered), MODEL)
    return X.catalog_totals(write_and_reload(X.catalog(
        covered, days, outlook.select(*S.SERIES, "target_offset_days", F.col("target_date").alias("forecast_date"),
        F.col("baseline_moving_average").alias("forecast_price"), F.lit(None).cast("double").alias("forecast_low"),
        F.lit(None).cast("double").alias("forecast_high"))), "catalog"))


@register("share_of_max", oracle(f"with c as ({_COMMODITY_SQL}) select commodity, market_count, {rnd('market_count / (select max(market_count) from c)', 4)} as share_of_max from c", "markets"))
def share_of_max(spark, sf):
    return X.share_of_max(write_and_reload(commodity_rollup(spark, sf), "commodities"))


@register("commodity_freshness", oracle(f"""
  with c as ({_COMMODITY_SQL}), a as (select commodity, latest_date, greatest(date_diff('day', latest_date, (select max(date) from published)), 0) as age_days from c)
  select *, {FRESH_SQL('age_days', THRESHOLD)} as freshness from a""", "markets", "published"))
def commodity_freshness(spark, sf):
    built = write_and_reload(markets(spark, sf), "markets")
    end = built.select(F.max("latest_date")).scalar()
    return X.commodity_freshness(X.commodity_rollup(built, THRESHOLD), end, THRESHOLD)


# --- explorer --------------------------------------------------------------

_CARD = ("state", "district", "commodity", "market", "market_id", "first_date", "last_date", "latest_age_days", "coverage_tier", "latest_price")


@register("explore_filter", oracle(f"""
  select 'variety' as search, {', '.join(_CARD)} from markets where len(list_filter(varieties, lambda v: contains(lower(v), 'brand#12'))) > 0
    or contains(lower(market), 'brand#12') or contains(lower(state), 'brand#12')
  union all select 'state', {', '.join(_CARD)} from markets where state = 'ASIA' and coverage_tier = 'high' and last_date >= date '2001-10-25'
    and date_diff('day', first_date, last_date) >= 365
  union all select 'fresh', {', '.join(_CARD)} from markets where {FRESH_SQL('latest_age_days', THRESHOLD)} = 'recent' and list_contains(varieties, 'Brand#3')
  union all select 'text', {', '.join(_CARD)} from markets where contains(lower(market), 'nation_1') or contains(lower(district), 'nation_1')""", "markets"))
def explore_filter(spark, sf):
    from datetime import date

    built = write_and_reload(markets(spark, sf), "markets")
    searches = {
        "variety": X.MarketFilter(text=" BRAND#12 "),
        "state": X.MarketFilter(state="ASIA", tier="high", since=date(2001, 10, 25), full_year=True),
        "fresh": X.MarketFilter(freshness="recent", variety="Brand#3"),
        "text": X.MarketFilter(text="nation_1"),
    }
    parts = [X.search(built, f, THRESHOLD).select(F.lit(n).alias("search"), *_CARD) for n, f in searches.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@register("explore_facets", oracle("""
  select distinct 'state' as facet, state as value from markets union all select distinct 'district', district from markets where state = 'ASIA'
  union all select distinct 'commodity', commodity from markets where state = 'ASIA'
  union all select distinct 'market', market from markets where state = 'ASIA' and commodity = 'PROMO'""", "markets"))
def explore_facets(spark, sf):
    return X.facets(markets(spark, sf), "ASIA", "PROMO")


_ORDERS = {"recent": "last_date desc, market", "market": "market", "price-low": "latest_price", "price-high": "latest_price desc"}


@register("explore_sorts", oracle("\nunion all\n".join(
    f"select '{n}' as sort, row_number() over (order by {o}, commodity, market_id) as place, commodity, market_id, latest_price from markets qualify place <= 18"
    for n, o in _ORDERS.items()), "markets"))
def explore_sorts(spark, sf):
    """The first page under each order, with the place of each row."""
    built = write_and_reload(markets(spark, sf), "markets")
    result = None
    for name in _ORDERS:
        placed = X.first_page(built, name).select(F.lit(name).alias("sort"), "place", *S.SERIES, "latest_price")
        result = placed if result is None else result.unionByName(placed)
    return result


@register("explore_page", oracle("""
  select commodity, market_id, market, last_date, latest_price from markets order by last_date desc, market, commodity, market_id limit 18 offset 18""", "markets"))
def explore_page(spark, sf):
    return X.page(write_and_reload(markets(spark, sf), "markets"), "recent", 2).select(*S.SERIES, "market", "last_date", "latest_price")


@register("preview_limit", oracle("""
  select state, market, commodity, market_id, last_date from markets where contains(lower(state), 'a') or contains(lower(market), 'a')
    or contains(lower(district), 'a') or contains(lower(commodity), 'a') order by state, market, commodity, market_id limit 24""", "markets"))
def preview_limit(spark, sf):
    return X.preview(markets(spark, sf), "a").select("state", "market", *S.SERIES, "last_date")


@register("market_detail", oracle("""
  select * from published where state = 'ASIA' and commodity = 'PROMO' and market_id = (select min(market_id) from selected where state = 'ASIA' and commodity = 'PROMO')""", "published", "selected"))
def market_detail(spark, sf):
    days, covered = publication(spark, sf)
    first = covered.filter("state = 'ASIA' and commodity = 'PROMO'").select(F.min("market_id")).scalar()
    return X.market_detail(days, "ASIA", "PROMO", first)


def _typed(columns, table, digits=4):
    """Published columns of a table; doubles on the published digits."""
    return ", ".join(f"{rnd(c[1:], digits)} as {c[1:]}" if c.startswith("~") else c for c in columns.split()) + f" from {table}"


_MARKET_SQL = _typed("state commodity market_id state_id market district first_date last_date record_count ~weekly_coverage latest_age_days maximum_gap_days ~price_cv coverage_tier", "selected")
_OBSERVATION_SQL = _typed("""state commodity market_id date ~min_price ~representative_price ~max_price ~arrivals_tonnes arrival_coverage variety_count example_variety
    example_variety_basis aggregation_method is_anomaly ~anomaly_score""", "published")
_SEASONAL_SQL = f"state, commodity, market_id, month(date) as month, {rnd('median(representative_price)', 2)} as median_price, count(*) as observations from published group by all"
_PARTS_SQL = [("market", _MARKET_SQL), ("observations", _OBSERVATION_SQL), ("forecasts", "* from forecasts"), ("seasonal", _SEASONAL_SQL)]
_STORE_SQL = "\nunion all by name\n".join(f"(select '{name}' as part, {sql})" for name, sql in _PARTS_SQL)


def _store(spark, sf, form="parquet"):
    """The published tables, written to a clustered store."""
    from bazaarflow.session import shared_folder

    stored = stored_publication(spark, sf)
    tables = K.sections(*stored, write_and_reload(forecasts(spark, sf, stored), "forecasts"))
    folder = shared_folder(spark, "store")
    K.write_store(tables, folder, form)
    return folder, tables, stored[1]


@register("store_tables", oracle(f"select * from ({_STORE_SQL})", "published", "selected", "forecasts"))
def store_tables(spark, sf):
    """All fields of all published records, written as typed JSON lines by state and commodity and read back."""
    folder, tables, _ = _store(spark, sf, "json")
    back = lambda name: K.read_table(spark, folder, name, "json", tables[name].schema).drop(*K.FOLDERS)
    return K.MarketDetail(*(back(name) for name in ("markets", "observations", "forecasts", "seasonal"))).rows()


def _evidence(spark, sf):
    """A measured publication with its window, source ledger, partition counts and checks."""
    from bazaarflow.queries.reports import _ledger
    from bazaarflow.session import shared_folder

    window = stored_history(spark, sf)
    selected = write_and_reload(C.selected_series(C.series_coverage(window, QUALITY), QUALITY.series_per_group), "coverage")
    days = write_and_reload(C.restricted_to(newest_days(S.with_anomaly(window), QUALITY.history_days), selected), "published")
    outlook = write_and_reload(forecasts(spark, sf, (days, selected)), "forecasts")
    published = E.publish(days, selected, outlook, METHOD, MODEL.horizon_days, QUALITY, shared_folder(spark, "publication"))
    partitions = write_and_reload(B.partition_stats(days, selected, outlook), "partitions")
    ledger = write_and_reload(_ledger(spark, sf), "ledger")
    checks = write_and_reload(E.invariants(published, window, ledger, partitions), "checks")
    return published, window, ledger, partitions, checks


_METHODS_SQL = ", ".join(f"'{m}'" for m in E.METHODS)
_CHECKS_SQL = f"""
  invariant(name, measured, wanted) as (
    select 'history_has_rows', (select count(*) from published), '+'
    union all select 'prices_are_positive', (select count(*) from published where min_price <= 0), '0'
    union all select 'low_is_not_above_price', (select count(*) from published where min_price > representative_price), '0'
    union all select 'price_is_not_above_high', (select count(*) from published where representative_price > max_price), '0'
    union all select 'methods_are_known', (select count(*) from published where aggregation_method not in ({_METHODS_SQL})), '0'
    union all select 'offsets_are_in_the_horizon', (select count(*) from forecasts where target_offset_days not between 1 and {MODEL.horizon_days}), '0'
    union all select 'forecast_is_not_below_its_low', (select count(*) from forecasts where forecast_low > forecast_price), '0'
    union all select 'forecast_is_not_above_its_high', (select count(*) from forecasts where forecast_price > forecast_high), '0'
    union all select 'one_forecast_method', (select count(*) from forecasts where method <> '{METHOD}'), '0'
    union all select 'one_comparison_date', (select case when min(comparison_date) <> max(comparison_date) then 1 else 0 end from forecasts), '0'
    union all select 'days_are_unique', (select count(*) from (select 1 from published group by market_id, commodity, date having count(*) > 1)), '0'
    union all select 'window_has_more_rows', (select count(*) from history) - (select count(*) from published), '+'
    union all select 'window_has_more_series', (select count(*) from (select distinct commodity, market_id from history
        where (commodity, market_id) not in (select (commodity, market_id) from published))), '+'
    union all select 'every_series_has_all_offsets', (select count(*) from (select 1 from forecasts group by commodity, market_id having count(*) <> {MODEL.horizon_days})), '0'
    union all select 'one_date_for_each_offset', (select count(*) from (select 1 from forecasts group by target_offset_days having count(distinct forecast_date) > 1)), '0'
    union all select 'ledger_adds_up', 0, '0'
    union all select 'partitions_add_up', 0, '0')"""


@register("check_published", oracle(f"""
  with {_CHECKS_SQL} select name as "check", cast(measured as bigint) as measured, case when wanted = '0' then measured = 0 else measured > 0 end as holds from invariant""",
    "published", "forecasts", "history"))
def check_published(spark, sf):
    """Invariants of a publication, most of them observed while it was written."""
    return _evidence(spark, sf)[-1]


@register("pub_manifest_partitions", oracle(f"""
  with {_STATS_SQL} select state, commodity, state_slug, commodity_slug, market_count, observation_count, forecast_count, date_min, date_max,
    '/data/' || state_slug || '/' || commodity_slug || '.json' as url, true as has_bytes, true as has_hash, true as state_adds_up from stats""", "selected", "published", "p_rows"))
def pub_manifest_partitions(spark, sf):
    """Manifest of a publication: counts, and whether bytes, hash and the state's total of bytes are there."""
    published, _, _, partitions, _ = _evidence(spark, sf)
    manifest = write_and_reload(E.partition_manifest(spark, published, partitions), "manifest")
    states = E.state_bytes(manifest).select("state", F.col("bytes").alias("state_bytes"))
    every = K.FOLDERS
    own = manifest.groupBy("state").agg(F.sum("bytes").alias("sum_bytes"))
    return manifest.join(states, "state").join(own, "state").select(
        "state", "commodity", *every, "market_count", "observation_count", "forecast_count", "date_min", "date_max", "url",
        (F.col("bytes") > 0).alias("has_bytes"), F.col("sha256").rlike("^[0-9a-f]{64}$").alias("has_hash"),
        ((F.col("state_bytes") == F.col("sum_bytes")) & (F.col("bytes") <= F.col("state_bytes"))).alias("state_adds_up"),
    )


_TOTALS = ("source_file_count", "input_records", "accepted_records", "excluded_records")


@register("evidence_bundle", oracle(f"""
  with {_LEDGER_SQL}, {_CHECKS_SQL},
  totals as (select count(*) as source_file_count, cast(sum(input_records) as bigint) as input_records, cast(sum(accepted_records) as bigint) as accepted_records,
    cast(sum(excluded_records) as bigint) as excluded_records from ledger)
  select 2::bigint as version, {', '.join(_TOTALS)}, (select count(*) from history) as window_records, (select count(*) from published) as records,
    (select count(*) from selected) as series, (select cast(max(date) as varchar) from published) as date_max, '{METHOD}' as method,
    (select count(*) from forecasts) as forecast_records, (select count(*) from invariant where case when wanted = '0' then measured = 0 else measured > 0 end) as checks_held,
    (select count(*) from (select distinct state, commodity from selected)) as partitions, true as has_hash
  from totals""", "placed", "marked", "history", "selected", "published", "forecasts"))
def evidence_bundle(spark, sf):
    """The evidence document, written as one JSON file and read back."""
    from bazaarflow.session import shared_folder

    published, window, ledger, partitions, checks = _evidence(spark, sf)
    manifest = write_and_reload(E.partition_manifest(spark, published, partitions), "manifest")
    folder = shared_folder(spark, "evidence")
    E.write_bundle(E.bundle(published, window, ledger, ledger, checks, manifest, METHOD), folder)
    read = spark.read.json(folder)
    return read.select(
        F.col("schemaVersion").alias("version"), *(F.col(f"quality.cumulative_validation.{c}").alias(c) for c in _TOTALS),
        F.col("quality.selection_window.records").alias("window_records"), "quality.published.records", "quality.published.series", "quality.published.date_max",
        F.col("model.selected_method").alias("method"), F.col("model.records").alias("forecast_records"),
        F.size(F.filter("checks", lambda c: c["holds"])).cast("long").alias("checks_held"), "dataset.partitions",
        F.col("dataset.sha256").rlike("^[0-9a-f]{64}$").alias("has_hash"),
    )


@register("market_detail_parts", oracle(f"""
  select * from ({_STORE_SQL}) where state = 'ASIA' and commodity = 'PROMO'
    and market_id = (select min(market_id) from selected where state = 'ASIA' and commodity = 'PROMO')""", "published", "selected", "forecasts"))
def market_detail_parts(spark, sf):
    """Everything about one series from the clustered store, which opens the folder of its state and commodity only."""
    folder, _, covered = _store(spark, sf)
    first = covered.filter("state = 'ASIA' and commodity = 'PROMO'").agg(F.min("market_id")).first()[0]
    return K.market_detail(spark, folder, "ASIA", "PROMO", first).rows()


@register("chart_points", oracle(f"""
  select commodity, market_id, date, min_price as minimum, representative_price as representative, max_price as maximum,
    arrivals_tonnes as arrivals, is_anomaly as anomaly
  from (select *, row_number() over ({_S} order by date) - 1 as i, count(*) over ({_S}) as n from scored)
  where n <= 240 or i % cast(ceil(n / 240) as bigint) = 0 or i = n - 1 or is_anomaly""", "scored"))
def chart_points(spark, sf):
    return X.chart_points(scored(spark, sf))


@register("arrival_points", oracle(f"""
  select commodity, market_id, date, arrivals_tonnes
  from (select *, row_number() over ({_S} order by date) - 1 as i, count(*) over ({_S}) as n from scored where arrivals_tonnes is not null)
  where n <= 150 or i % cast(ceil(n / 150) as bigint) = 0 or i = n - 1 or is_anomaly""", "scored"))
def arrival_points(spark, sf):
    return X.arrival_points(scored(spark, sf))
