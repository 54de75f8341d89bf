"""Registered queries: scans, text, numbers, dates and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow.functions import buckets, dates, numbers, text
from bazaarflow.operators import compare, files
from bazaarflow.operators.features import origins
from bazaarflow.queries.base import (
    FRESH_SQL, MODEL, QUALITY, SLUG_SQL, VOLATILITY_SQL, coverage, history, oracle, register, rnd, tiered,
)
from bazaarflow.session import shared_folder, write_and_reload
from bazaarflow.sources import raw_json, reference_dims, tables as T

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
# entry count of the document of one line
ENTRIES = "case when l_linenumber = 1 and l_returnflag = 'N' then 0 when l_linenumber = 3 then 2 else 1 end"
NO_DATES = "(l_linenumber = 2 and l_returnflag = 'N')"
# orders whose lines make up one source document
_CHUNK = 1_000_000
FOLD_SQL = lambda v: f"translate(replace(lower({v}), 'ß', 'ss'), 'ς', 'σ')"


def _documents(spark, sf):
    return T.parsed_documents(T.raw_documents(spark, sf))


@register("src_nested_json", oracle(f"""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, true as success, upper(s_name) as market_name,
    case when {NO_DATES} then null else 1 end as dates, case when {NO_DATES} then null else {ENTRIES} end as entries
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"""))
def src_nested_json(spark, sf):
    first = F.get("markets", F.lit(0))
    found = F.when(first["dates"].isNotNull(), F.size(first["dates"]))
    return _documents(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "success",
        first["marketName"].alias("market_name"), found.alias("dates"),
        F.when(first["dates"].isNotNull(), F.size(F.get(first["dates"], F.lit(0))["data"])).alias("entries"),
    )


@register("src_flatten", oracle(f"""
  with modal as (select *, {rnd('l_extendedprice / l_quantity', 2)} as m from lineitem join supplier on l_suppkey = s_suppkey)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, upper(s_name) as market_raw, cast(0 as bigint) as value_position,
    cast(l_shipdate as date) as date,
    case when {ENTRIES} = 0 or l_linenumber = 4 then 'Unspecified' else 'Grade ' || l_returnflag end as variety,
    case when {ENTRIES} > 0 then {rnd('m * (1 - l_discount)', 2)} end as min_price,
    case when {ENTRIES} > 0 then {rnd('m * (1 + l_tax)', 2)} end as max_price,
    case when {ENTRIES} > 0 then m end as modal_price,
    case when {ENTRIES} > 0 and l_returnflag <> 'R' then l_quantity end as arrivals_tonnes
  from modal where not {NO_DATES}
  union all
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, upper(s_name), 1, cast(l_shipdate as date), 'Other grade', null, m, m, null
  from modal where l_linenumber = 3"""))
def src_flatten(spark, sf):
    flat = raw_json.flattened(raw_json.market_entries(_documents(spark, sf)))
    return flat.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "market_raw",
        F.col("value_position").cast("long").alias("value_position"), "date", "variety",
        "min_price", "max_price", "modal_price", "arrivals_tonnes",
    )


@register("src_row_count", oracle(f"""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    cast(case when {NO_DATES} then 0 else greatest({ENTRIES}, 1) end as bigint) as record_count from lineitem"""))
def src_row_count(spark, sf):
    return _documents(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw_json.row_count(F.col("markets")).alias("record_count")
    )


@register("src_manifest", oracle(f"""
  select n_regionkey as state_id, strftime(l_shipdate, '%Y-%m') as source_month, count(*) as documents,
    cast(sum(case when {NO_DATES} then 0 else greatest({ENTRIES}, 1) end) as bigint) as record_count
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2"""))
def src_manifest(spark, sf):
    counted = _documents(spark, sf).withColumn("records", raw_json.row_count(F.col("markets")))
    return counted.groupBy("state_id", "source_month").agg(
        F.count("*").alias("documents"), F.sum("records").alias("record_count")
    )


@register("src_manifest_files", oracle(f"""
  select n_regionkey as state_id, strftime(l_shipdate, '%Y-%m') as source_month, l_orderkey // {_CHUNK} as chunk,
    cast(sum(case when {NO_DATES} then 0 else greatest({ENTRIES}, 1) end) as bigint) as record_count, true as same_bytes, true as same_hash
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2, 3"""))
def src_manifest_files(spark, sf):
    """One nested JSON file for each state, month and run of orders; the manifest of these files, read back."""
    market = F.get_json_object("document", "$.markets[0]")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", market.alias("market"))
    key = ("state_id", "source_month", "chunk")
    text = F.concat(F.lit('{"success":true,"markets":['), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["market"]), ","), F.lit("]}"))
    texts = write_and_reload(
        T.raw_documents(spark, sf).withColumn("chunk", F.floor(F.col("l_orderkey") / _CHUNK)).groupBy(*key).agg(text.alias("text")), "documents")
    folder = shared_folder(spark, "document-files")
    # a key is one row, so it is one file without any shuffle
    texts.withColumnsRenamed({k: f"_{k}" for k in key}).write.partitionBy(*(f"_{k}" for k in key)).text(folder)
    # files of a text table end in .txt
    found = files.source_manifest(spark, folder, 16_384, "*.txt")
    part = lambda name: F.regexp_extract("path", f"/_{name}=([^/]*)/", 1)
    placed = found.select(part("state_id").cast("long").alias("state_id"), part("source_month").alias("source_month"), part("chunk").cast("long").alias("chunk"),
                          "record_count", "bytes", "sha256", "ranges")
    # texts are measured where they lie; only sizes and hashes meet the manifest
    content = F.concat("text", F.lit("\n"))
    own = texts.select(*key, F.octet_length(content).alias("own_bytes"), F.sha2(content.cast("binary"), 256).alias("own_sha256"))
    same_hash = (F.col("ranges") > 1) | (F.col("sha256") == F.col("own_sha256"))
    return placed.join(own, list(key)).select(*key, "record_count", (F.col("bytes") == F.col("own_bytes")).alias("same_bytes"), same_hash.alias("same_hash"))


@register("src_reference_dims", oracle(f"""
  select cast(n_regionkey as bigint) as state_id, lower(s_name) as market_key, s_suppkey + 1000 as reference_id,
    case when s_suppkey % 5 <> 0 then n_nationkey end as district_id, case when s_suppkey % 5 <> 0 and n_nationkey <> 3 then n_name end as district
  from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 7 <> 0"""))
def src_reference_dims(spark, sf):
    markets = reference_dims.market_lookup(T.reference_markets(spark, sf))
    return markets.join(reference_dims.district_lookup(T.reference_districts(spark, sf)), "district_id", "left")


def _resolved(spark, sf):
    reports = T.table(spark, sf, "lineitem").select(*LINE[:4]).join(
        T.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        *LINE[:4], F.col("n_regionkey").cast("long").alias("state_id"), F.upper("s_name").alias("market_raw")
    )
    return reference_dims.resolve_markets(
        reports, reference_dims.market_lookup(T.reference_markets(spark, sf)),
        reference_dims.district_lookup(T.reference_districts(spark, sf)),
    )


_LOOKUP = """lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"""


@register("join_reference_left", oracle(f"""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, upper(s_name) as market_raw,
    upper(s_name[1]) || lower(s_name[2:]) as market,
    case when s_suppkey % 7 <> 0 then n_regionkey || '-' || (s_suppkey + 1000)
         else 'derived-' || n_regionkey || '-' || sha1(lower(s_name))[1:10] end as market_id,
    s_suppkey % 7 <> 0 as resolved
  from {_LOOKUP}"""))
def join_reference_left(spark, sf):
    return _resolved(spark, sf).select(*LINE[:4], "market_raw", "market", "market_id", "resolved")


@register("join_district", oracle(f"""
  select case when s_suppkey % 7 <> 0 and s_suppkey % 5 <> 0 and n_nationkey <> 3 then n_name else 'Unknown' end as district,
    count(*) as reports, count(distinct s_suppkey) as markets
  from {_LOOKUP} group by 1"""))
def join_district(spark, sf):
    return _resolved(spark, sf).groupBy("district").agg(
        F.count("*").alias("reports"), F.count_distinct("market_id").alias("markets")
    )


@register("val_corrections", oracle(f"""
  select cast(n_regionkey as bigint) as state_id, count(*) as market_entries, count(*) as corrected_records,
    count(*) filter (where s_suppkey % 7 = 0) as unresolved_market_references
  from {_LOOKUP} group by 1"""))
def val_corrections(spark, sf):
    from bazaarflow.operators.validate import entry_corrections

    return entry_corrections(_resolved(spark, sf), ["state_id"])


@register("src_overlay_latest", oracle("""
  with months as (select distinct state_id, state, commodity, date_trunc('month', date) as m from placed),
  files as (
    select state_id, commodity, strftime(m, '%Y-%m') as source_month, 0 as layout_priority,
      '/raw/' || lower(commodity) || '/' || strftime(m, '%Y-%m') || '.json' as source_file
    from months where state_id = 2
    union all
    select state_id, commodity, strftime(m, '%Y-%m'), 1,
      '/raw/' || state_id || '-' || replace(lower(state), ' ', '-') || '/' || lower(commodity) || '/' || strftime(m, '%Y-%m') || '.json'
    from months where month(m) % 3 <> 0)
  select state_id, lower(commodity) as commodity_slug, source_month, max(layout_priority) as layout_priority,
    arg_max(source_file, layout_priority) as source_file
  from files where source_month between '1996-03' and '2001-05' group by 1, 2, 3""", "placed"))
def src_overlay_latest(spark, sf):
    months = T.variety_reports(spark, sf).select(
        "state_id", "state", "commodity", F.date_format("date", "yyyy-MM").alias("m")
    ).distinct()
    crop = text.slug(F.col("commodity"))
    old = months.filter("state_id = 2").select(F.concat(F.lit("/raw/"), crop, F.lit("/"), "m", F.lit(".json")).alias("source_file"))
    new = months.filter(F.substring("m", 6, 2).cast("int") % 3 != 0).select(
        F.concat(F.lit("/raw/"), F.col("state_id").cast("string"), F.lit("-"), text.slug(F.col("state")),
                 F.lit("/"), crop, F.lit("/"), "m", F.lit(".json")).alias("source_file")
    )
    files = raw_json.located(old.unionByName(new), legacy_state_id=2)
    permitted = raw_json.within_months(files, F.lit("1996-03-01").cast("date"), F.lit("2001-05-31").cast("date"))
    return raw_json.latest_layout(permitted)


@register("gen_months", oracle("""
  select year(m) as year, month(m) as month, strftime(m, '%Y-%m') as month_key from (
    select unnest(generate_series(date_trunc('month', min(l_shipdate)), date_trunc('month', max(l_shipdate)), interval 1 month)) as m
    from lineitem)"""))
def gen_months(spark, sf):
    bounds = T.table(spark, sf, "lineitem").agg(
        F.min("l_shipdate").cast("date").alias("start_date"), F.max("l_shipdate").cast("date").alias("end_date")
    )
    return dates.months_between(bounds)


@register("recent_months_scan", oracle("""
  select commodity, strftime(date, '%Y-%m') as source_month, count(*) as reports,
    cast(sum(modal_price * 100) as bigint) as modal_cents
  from placed where date >= date_trunc('month', (select max(cast(l_shipdate as date)) from lineitem)) - interval 1 month
  group by 1, 2""", "placed"))
def recent_months_scan(spark, sf):
    end = T.table(spark, sf, "lineitem").select(F.max("l_shipdate").cast("date")).scalar()
    recent = T.variety_reports(spark, sf).filter(F.col("date") >= dates.refresh_start(end))
    return recent.groupBy("commodity", F.date_format("date", "yyyy-MM").alias("source_month")).agg(
        F.count("*").alias("reports"),
        F.sum(F.col("modal_price").cast("decimal(18,2)") * 100).cast("long").alias("modal_cents"),
    )


# --- text ------------------------------------------------------------------

@register("str_normalized_key", oracle(f"""
  select doc_id, {FOLD_SQL("trim(regexp_replace(text, '[\\s\\x{0B}\\x{85}\\x{A0}]+', ' ', 'g'))")} as normalized_key from documents"""))
def str_normalized_key(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", text.normalized_key(F.col("text")).alias("normalized_key"))


_NAME = """case c_custkey % 4 when 0 then '  ' || c_mktsegment || '   APMC (' || upper(c_name) || ')'
  when 1 then c_name || ' Ap Mc' when 2 then 'AP MC  ' || c_mktsegment || ' ' else lower(c_name) end"""


@register("str_display_name", oracle(f"""
  select c_custkey, replace(replace(case when s = upper(s) and s <> lower(s) then
      array_to_string(list_transform(regexp_extract_all(lower(s), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda t: upper(t[1]) || t[2:]), '')
    else s end, 'Apmc', 'APMC'), 'Ap Mc', 'APMC') as display_name
  from (select c_custkey, trim(regexp_replace({_NAME}, '\\s+', ' ', 'g')) as s from customer)"""))
def str_display_name(spark, sf):
    return T.table(spark, sf, "customer").select("c_custkey", text.display_name(F.expr(_NAME)).alias("display_name"))


_VARIETY = "case p_partkey % 4 when 0 then null when 1 then '' when 2 then '   ' else ' ' || p_brand || '  a ' end"


@register("str_variety_default", oracle(f"""
  select p_partkey, trim(regexp_replace(coalesce(nullif({_VARIETY}, ''), 'Unspecified'), '\\s+', ' ', 'g')) as variety from part"""))
def str_variety_default(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", text.variety_name(F.expr(_VARIETY)).alias("variety"))


@register("str_slug", oracle(f"select doc_id, {SLUG_SQL('text')} as slug from documents"))
def str_slug(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


# for the check: the accented letters of the documents and the plain letters they decompose to
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


@register("str_slug_ascii", oracle(f"""
  select doc_id, regexp_replace(regexp_replace(translate(regexp_replace(lower(text), '([{_ACCENTED}])', '\\1-', 'g'),
    '{_ACCENTED}', '{_PLAIN}'), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') as slug from documents"""))
def str_slug_ascii(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", text.ascii_slug(F.col("text")).alias("slug"))


@register("str_stable_id", oracle("""
  select s_suppkey, 'derived-' || s_nationkey || '-' || sha1(lower(s_name))[1:10] as market_id from supplier"""))
def str_stable_id(spark, sf):
    return T.table(spark, sf, "supplier").select(
        "s_suppkey", text.derived_market_id(F.col("s_nationkey"), F.col("s_name")).alias("market_id")
    )


@register("str_series_key", oracle(f"""
  select distinct state, commodity, market_id, {SLUG_SQL('state')} || '/' || {SLUG_SQL('commodity')} || '/' || market_id as key from placed""", "placed"))
def str_series_key(spark, sf):
    return T.variety_reports(spark, sf).select("state", "commodity", "market_id").distinct().withColumn(
        "key", text.series_key(F.col("state"), F.col("commodity"), F.col("market_id"))
    )


@register("flt_text_search", oracle("""
  select doc_id from documents where contains(lower(text), 'tion') or contains(lower(source), 'src1') or contains(lower(lang), 'tion')"""))
def flt_text_search(spark, sf):
    return T.table(spark, sf, "documents").filter(
        text.mentions(" TION ", F.col("text"), F.col("lang")) | text.mentions("SRC1", F.col("source"))
    ).select("doc_id")


# --- numbers and dates -----------------------------------------------------

_SPELLED = """case l_linenumber when 1 then {money} when 2 then ' 12.5 ' when 3 then 'nan' when 4 then ''
  when 5 then '1e5' when 6 then '12d' else null end"""


@register("num_parse", oracle(f"""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    case when s = '' or s is null then null when s in ('nan', '12d') then null else cast(trim(replace(s, ',', '')) as double) end as number
  from (select *, {_SPELLED.format(money="format('{:,.2f}', l_extendedprice)")} as s from lineitem)"""))
def num_parse(spark, sf):
    spelled = F.expr(_SPELLED.format(money="format_number(l_extendedprice, 2)"))
    return T.table(spark, sf, "lineitem").select(*LINE[:4], numbers.parse_number(spelled).alias("number"))


@register("date_parse_multi", oracle("""
  select o_orderkey, case when o_orderkey % 5 = 4 then null else cast(o_orderdate as date) end as date from orders"""))
def date_parse_multi(spark, sf):
    day = F.col("o_orderdate")
    spelled = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "d-M-yyyy"))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit(" "), F.date_format(day, "d/M/yyyy")))
        .otherwise(F.date_format(day, "yyyy.MM.dd"))
    )
    return T.table(spark, sf, "orders").select("o_orderkey", dates.parse_report_date(spelled).alias("date"))


@register("date_parts", oracle("""
  select o_orderkey, strftime(o_orderdate, '%G-W%V') as iso_week, cast(date_trunc('week', o_orderdate) as date) as week_start,
    isodow(o_orderdate) - 1 as weekday, weekofyear(o_orderdate) as week, month(o_orderdate) as month,
    strftime(o_orderdate, '%Y-%m') as month_key, cast(o_orderdate as date) + 7 as next_week
  from orders"""))
def date_parts(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return T.table(spark, sf, "orders").select(
        "o_orderkey", dates.iso_week_key(day).alias("iso_week"), dates.week_start(day).alias("week_start"),
        F.weekday(day).alias("weekday"), F.weekofyear(day).alias("week"), F.month(day).alias("month"),
        dates.month_key(day).alias("month_key"), F.date_add(day, 7).alias("next_week"),
    )


@register("bucket_volatility", oracle(f"""
  select commodity, market_id, origin_date, {VOLATILITY_SQL('relative_volatility_30d')} as volatility_bucket
  from featured where report_number >= {MODEL.minimum_reports}""", "featured"))
def bucket_volatility(spark, sf):
    return origins(tiered(spark, sf), MODEL).select("commodity", "market_id", "origin_date", "volatility_bucket")


@register("bucket_freshness", oracle(f"""
  select commodity, market_id, latest_age_days, {FRESH_SQL('latest_age_days', QUALITY.stale_after_days)} as freshness from covered""", "covered"))
def bucket_freshness(spark, sf):
    return coverage(spark, sf).select(
        "commodity", "market_id", "latest_age_days",
        buckets.freshness(F.col("latest_age_days"), QUALITY.stale_after_days).alias("freshness"),
    )


@register("price_band_position", oracle(f"""
  select commodity, market_id, date, {rnd('least(greatest((representative_price - min_price) / (case when max_price = min_price then 1 else max_price - min_price end) * 100, 3), 97)', 4)} as band_position
  from history""", "history"))
def price_band_position(spark, sf):
    from bazaarflow.operators.explore import band_positions

    return band_positions(history(spark, sf))


_UNIT = "case l_linenumber % 3 when 0 then 'kg' when 1 then 'quintal' else 'tonne' end"
_METHOD = "case l_linenumber % 3 when 0 then 'total' when 1 then 'per_quintal' else 'per_tonne' end"


@register("cmp_units", oracle(f"""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, {rnd(f"case {_UNIT} when 'kg' then l_quantity / 100 when 'tonne' then l_quantity * 10 else l_quantity end", 4)} as quintals
  from lineitem"""))
def cmp_units(spark, sf):
    quintals = compare.to_quintals(F.col("l_quantity"), F.expr(_UNIT))
    return T.table(spark, sf, "lineitem").select(*LINE[:4], numbers.rounded(quintals, 4).alias("quintals"))


@register("cmp_transport", oracle(f"""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, {rnd(f"case {_METHOD} when 'per_quintal' then l_extendedprice / 100 * l_quantity when 'per_tonne' then l_extendedprice / 100 * (l_quantity / 10) else l_extendedprice / 100 end", 4)} as transport_cost
  from lineitem"""))
def cmp_transport(spark, sf):
    cost = compare.transport_cost(F.col("l_extendedprice") / 100, F.expr(_METHOD), F.col("l_quantity"))
    return T.table(spark, sf, "lineitem").select(*LINE[:4], numbers.rounded(cost, 4).alias("transport_cost"))
