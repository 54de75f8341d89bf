"""Registered queries: validation, duplicates, ledger and the market-day roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow.operators import validate as V
from bazaarflow.operators.market_day import market_days
from bazaarflow.plans import refresh
from bazaarflow.queries.base import (
    PARTS, QUALITY, checked, history, market_day_sql, marked, oracle, register,
)
from bazaarflow.session import in_pass, passes, shared_folder, shuffles_freed, write_and_reload
from bazaarflow.sources import tables as T

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copy"]
FILE = ["state_id", "state", "commodity", "source_month"]


@register("market_day", oracle("select * from accepted_days", "accepted_days"))
def market_day(spark, sf):
    return market_days(V.first_copies(checked(spark, sf), T.LINE_POSITION), deduplicated=True)


@register("market_day_clean", oracle("select * from history", "history"))
def market_day_clean(spark, sf):
    return history(spark, sf)


@register("market_day_zero_arrivals", oracle(market_day_sql(
    "(select * replace (case when arrivals_tonnes is not null then 0.0 end as arrivals_tonnes) from placed)"), "placed"))
def market_day_zero_arrivals(spark, sf):
    """Arrivals present but zero: the median price, yet complete coverage."""
    zero = F.when(F.col("arrivals_tonnes").isNotNull(), F.lit(0.0))
    return market_days(T.variety_reports(spark, sf).withColumn("arrivals_tonnes", zero))


@register("agg_example_variety", oracle("""
  select commodity, market_id, date, example_variety, example_variety_basis, variety_count from history""", "history"))
def agg_example_variety(spark, sf):
    return history(spark, sf).select(
        "commodity", "market_id", "date", "example_variety", "example_variety_basis", "variety_count"
    )


@register("agg_arrival_coverage", oracle("""
  select arrival_coverage, aggregation_method, count(*) as market_days,
    cast(sum(cast(arrivals_tonnes as decimal(18,3))) as double) as arrivals_tonnes
  from history group by 1, 2""", "history"))
def agg_arrival_coverage(spark, sf):
    return history(spark, sf).groupBy("arrival_coverage", "aggregation_method").agg(
        F.count("*").alias("market_days"),
        F.sum(F.col("arrivals_tonnes").cast("decimal(18,3)")).cast("double").alias("arrivals_tonnes"),
    )


@register("val_reason", oracle("""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, copy, first_reason as exclusion_reason from checked""", "checked"))
def val_reason(spark, sf):
    return checked(spark, sf).select(*LINE, V.REASON)


@register("val_exact_duplicate", oracle("""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, copy from marked where exclusion_reason = 'exact_duplicate'""", "marked"))
def val_exact_duplicate(spark, sf):
    return marked(spark, sf).filter(F.col(V.REASON) == "exact_duplicate").select(*LINE)


@register("val_accept_reject_split", oracle("""
  select case when exclusion_reason is null then 'accepted' else 'rejected' end as side, exclusion_reason,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, copy, min_price, max_price, modal_price, arrivals_tonnes
  from marked""", "marked"))
def val_accept_reject_split(spark, sf):
    """Both sides in one pass: the side is a column, which a partitioned write turns into two tables."""
    side = F.when(F.col(V.REASON).isNull(), "accepted").otherwise("rejected")
    return marked(spark, sf).select(
        side.alias("side"), V.REASON, *LINE, "min_price", "max_price", "modal_price", "arrivals_tonnes"
    )


_REASONS_SQL = """'{' || string_agg('"' || exclusion_reason || '":' || n, ',' order by exclusion_reason)
  filter (where exclusion_reason is not null) || '}'"""
LEDGER_SQL = f"""
  files as (select distinct s.state_id, s.state, c.commodity, m.source_month from
    (select distinct state_id, state from placed) s, (select distinct commodity from placed) c,
    (select distinct strftime(date, '%Y-%m') as source_month from placed) m),
  counts as (select state_id, commodity, source_month, exclusion_reason, count(*) as n from marked group by 1, 2, 3, 4),
  ledger as (select f.state_id, f.state, f.commodity, f.source_month,
      cast(coalesce(sum(n), 0) as bigint) as input_records,
      cast(coalesce(sum(n) filter (where exclusion_reason is null), 0) as bigint) as accepted_records,
      cast(coalesce(sum(n) filter (where exclusion_reason is not null), 0) as bigint) as excluded_records,
      coalesce({_REASONS_SQL}, '{{}}') as exclusion_reasons_json
    from files f left join counts using (state_id, commodity, source_month) group by 1, 2, 3, 4)"""


def _ledger(spark, sf):
    """Files of every state, commodity and month, also those without rows.

    The configured dimensions are small lists; months come from the reports.
    """
    placed = T.variety_reports(spark, sf)
    states = T.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("state_id"), F.col("r_name").alias("state"))
    months = placed.select(F.date_format("date", "yyyy-MM").alias("source_month")).distinct()
    crops = T.table(spark, sf, "part").select(F.col("p_type").alias("commodity")).distinct()
    listed = crops.agg(F.collect_set("commodity")).scalar()
    named = states.agg(F.collect_set(F.struct("state_id", "state"))).scalar()
    files = months.withColumn("commodity", F.explode(listed)).withColumn("s", F.explode(named)).select(
        "s.state_id", "s.state", "commodity", "source_month"
    )
    return V.quality_ledger(marked(spark, sf), files, FILE)


@register("quality_ledger", oracle(f"with {LEDGER_SQL} select * from ledger", "placed", "marked"))
def quality_ledger(spark, sf):
    return _ledger(spark, sf)


@register("quality_reasons", oracle("""
  select exclusion_reason, replace(exclusion_reason, '_', ' ') as label, count(*) as n from marked
  where exclusion_reason is not null group by 1""", "marked"))
def quality_reasons(spark, sf):
    return V.reason_counts(marked(spark, sf))


@register("quality_cumulative", oracle(f"""
  with {LEDGER_SQL} select count(*) as source_file_count, cast(sum(input_records) as bigint) as input_records,
    cast(sum(accepted_records) as bigint) as accepted_records, cast(sum(excluded_records) as bigint) as excluded_records,
    sum(input_records) = sum(accepted_records) + sum(excluded_records) as reconciles from ledger""", "placed", "marked"))
def quality_cumulative(spark, sf):
    return V.cumulative_quality(_ledger(spark, sf))


# --- merge of ledgers ------------------------------------------------------

# The earlier sources lack one crop's last year; the current ones lack another crop's first years and have other prices in a third's.
_NEW = "commodity = 'PROMO' and source_month >= '2001-01'"
_GONE = "commodity = 'SMALL' and source_month < '1996-01'"
_OTHER = "commodity = 'LARGE' and source_month between '1999-01' and '1999-12' and l_linenumber = 1"
PARTS["old_defective"] = (f"select * from defective where not ({_NEW})", ("defective",))
PARTS["new_defective"] = (f"select * replace (case when {_OTHER} then modal_price + 1 else modal_price end as modal_price) from defective where not ({_GONE})", ("defective",))
for _age in ("old", "new"):
    PARTS[f"{_age}_checked"] = (PARTS["checked"][0].replace("from defective", f"from {_age}_defective"), (f"{_age}_defective",))
    PARTS[f"{_age}_marked"] = (PARTS["marked"][0].replace("from checked", f"from {_age}_checked"), (f"{_age}_checked",))
_TEXT = ", ".join(f"coalesce(cast({f'cast({c} as decimal(18,4))' if c.endswith(('price', 'tonnes')) else c} as varchar), '-')" for c in refresh.CONTENT)
_COUNTED = lambda age: f"""
  {age}_hashes as (select state, state_id, commodity, source_month, sha256(count(*) || '|' || sum(h) || '|' || bit_xor(h)) as source_sha256
    from (select *, ('0x' || substr(md5(concat_ws('|', {_TEXT})), 1, 15))::bigint as h from {age}_defective) group by 1, 2, 3, 4),
  {age}_counts as (select state_id, commodity, source_month, exclusion_reason, count(*) as n from {age}_marked group by 1, 2, 3, 4),
  {age}_ledger as (select f.state, f.state_id, f.commodity, f.source_month, source_sha256, cast(sum(n) as bigint) as input_records,
      cast(coalesce(sum(n) filter (where exclusion_reason is null), 0) as bigint) as accepted_records,
      cast(coalesce(sum(n) filter (where exclusion_reason is not null), 0) as bigint) as excluded_records,
      coalesce({_REASONS_SQL}, '{{}}') as exclusion_reasons_json
    from {age}_hashes f join {age}_counts using (state_id, commodity, source_month) group by 1, 2, 3, 4, 5)"""  # noqa: E731
_CHANGED = """changed as (select n.* from new_hashes n left join old_hashes o using (state_id, commodity, source_month)
    where o.source_sha256 is null or o.source_sha256 <> n.source_sha256)"""


def _by_month(reports):
    """Dealt by month without ranges, whose sample would read and join the lines once more; large months are split."""
    return reports.hint("rebalance", "source_month")


def _source_versions(spark, sf):
    """The current sources, in a folder for each month, and the ledger of the earlier ones.

    Both versions read one stored table of all reports; each leaves out its rows and sets its prices where it is read.
    """
    reports = T.defective_reports(spark, sf)
    folder = shared_folder(spark, "sources")
    n = passes(T.table(spark, sf, "lineitem").count())
    with shuffles_freed(spark):
        for i in range(n):  # a month is dealt and written in one pass
            own = reports.filter(in_pass(i, n, "source_month"))
            _by_month(own).write.mode("append").partitionBy("source_month").option("compression", "zstd").parquet(folder)
    # the folder's names would else be read as dates
    kept = spark.read.schema(reports.schema).parquet(folder)
    other = F.when(F.expr(_OTHER), F.col("modal_price") + 1).otherwise(F.col("modal_price"))
    current, earlier = kept.filter(~F.expr(_GONE)).withColumn("modal_price", other), kept.filter(~F.expr(_NEW))
    nothing = spark.createDataFrame([], "state_id long, state string, commodity string, source_month string, source_sha256 string")
    ledger = refresh.changes(earlier, nothing, T.LINE_POSITION, QUALITY).ledger
    return current, write_and_reload(ledger, "ledger")


@register("ledger_merge", oracle(f"""
  with {_COUNTED('old')},{_COUNTED('new')}, {_CHANGED}
  select * from new_ledger where (state_id, commodity, source_month) in (select (state_id, commodity, source_month) from changed)
  union all by name
  select * from old_ledger where (state_id, commodity, source_month) not in (select (state_id, commodity, source_month) from changed)""", "old_marked", "new_marked"))
def ledger_merge(spark, sf):
    """Published ledger after a refresh that reads only sources whose content hash changed."""
    return refresh.changes(*_source_versions(spark, sf), T.LINE_POSITION, QUALITY).ledger


@register("refresh_rejected", oracle(f"""
  with {_COUNTED('old')},{_COUNTED('new')}, {_CHANGED}
  select {', '.join(LINE)}, state_id, commodity, source_month, exclusion_reason from new_marked where exclusion_reason is not null
    and (state_id, commodity, source_month) in (select (state_id, commodity, source_month) from changed)""", "old_marked", "new_marked"))
def refresh_rejected(spark, sf):
    """Reports of the changed sources that the refresh rejects, written and read back."""
    found = refresh.changes(*_source_versions(spark, sf), T.LINE_POSITION, QUALITY)
    return write_and_reload(found.rejected(), "rejected").select(*LINE, "state_id", "commodity", "source_month", V.REASON)
