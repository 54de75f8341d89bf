"""Registered queries: streaming jobs run to the end of their input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow.operators.series import PRICE
from bazaarflow.operators.upsert import HISTORY_KEY
from bazaarflow.operators.validate import DUPLICATE_KEY, REASON
from bazaarflow.functions.dates import utc_instant
from bazaarflow.functions.numbers import rounded
from bazaarflow.functions.text import casefolded
from bazaarflow.queries.base import ORACLES, QUALITY, history, oracle, register, rnd
from bazaarflow.session import shared_folder, write_and_reload
from bazaarflow.sources import tables as T
from bazaarflow.streaming import jobs

_FLAT = ("market_raw", "date", "variety", "min_price", "max_price", "modal_price", "arrivals_tonnes")


def streamed(spark, folder: str, name: str):
    """A table as a stream, be it a file or a folder of files. The pattern keeps a file from being taken as base folder."""
    pattern = f"{folder}/[{name[0]}]{name[1:]}.parquet"
    return spark.readStream.schema(T.table(spark, folder, name).schema).parquet(pattern)


@register("stream_validate", f"""
  with flat as ({ORACLES['src_flatten']})
  select {', '.join(_FLAT)}, case
    when date < date '{QUALITY.start_date}' or date > date '{QUALITY.end_date}' then 'outside_requested_date_range'
    when min_price is null or max_price is null or modal_price is null then 'unparseable_price'
    when least(min_price, max_price, modal_price) <= 0 then 'non_positive_price'
    when greatest(min_price, max_price, modal_price) > {QUALITY.maximum_price} then 'price_above_safety_ceiling'
    when not (min_price <= modal_price and modal_price <= max_price) then 'invalid_price_order' end as exclusion_reason
  from flat""")
def stream_validate(spark, sf):
    inbox, outbox = shared_folder(spark, "inbox"), shared_folder(spark, "validated")
    T.raw_documents(spark, sf).select(F.col("document").alias("value")).write.text(inbox)
    stream = jobs.validated_stream(jobs.arriving_documents(spark, inbox), QUALITY)
    shown = stream.select(*_FLAT, REASON, "side")
    jobs.write_to_end(shown, outbox, shared_folder(spark, "progress"), ["side"])
    return spark.read.schema(shown.schema).parquet(outbox).select(*_FLAT, REASON)


_HELD_BACK = 7  # number of the order lines that arrive last


def _as_reports(spark, sf, lines):
    """Order lines, a table or a stream, as reports with the instant of their day."""
    return (
        lines.join(T.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(T.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(T.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            utc_instant(F.col("l_shipdate")).alias("event_time"), F.col("p_type").alias("commodity"),
            F.concat_ws("-", F.col("r_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("market_id"),
            casefolded(F.col("p_brand")).alias("variety_key"), F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_extendedprice").alias("min_price"), F.col("l_extendedprice").alias("max_price"),
            F.col("l_quantity").alias("modal_price"), (F.col("l_linenumber") == _HELD_BACK).alias("held_back"),
        )
    )


@register("stream_dedup", oracle("""
  select distinct p_type as commodity, r.r_regionkey || '-' || n.n_nationkey as market_id, lower(p_brand) as variety_key, cast(l_shipdate as date) as date,
    l_extendedprice as min_price, l_extendedprice as max_price, l_quantity as modal_price
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation n on s_nationkey = n_nationkey join region r on n_regionkey = r_regionkey"""))
def stream_dedup(spark, sf):
    """Lines sent twice, as a stream joined with the static tables."""
    reports = _as_reports(spark, sf, streamed(spark, sf, "lineitem")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    folder = shared_folder(spark, "deduplicated")
    # what is there arrives as one batch, so nothing is late; copies meet within two days, then state goes
    kept = jobs.deduplicated_stream(reports, "event_time", "2 days").select(*DUPLICATE_KEY)
    jobs.write_to_end(kept, folder, shared_folder(spark, "progress"))
    return spark.read.schema(kept.schema).parquet(folder)


_LATE_SQL = f"""
  with sent as (select distinct p_type as commodity, r.r_regionkey || '-' || n.n_nationkey as market_id, lower(p_brand) as variety_key,
      cast(l_shipdate as date) as date, l_extendedprice as price, l_quantity as quantity, l_linenumber = {_HELD_BACK} as held_back
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    join nation n on s_nationkey = n_nationkey join region r on n_regionkey = r_regionkey),
  ends as (select max(date) filter (where not held_back) as first_end, max(date) as last_end from sent),
  kept as (select distinct commodity, market_id, variety_key, date, price, quantity from sent, ends where not held_back or date > first_end - 2),
  counted as (select date, count(*) as n from kept group by 1),
  all_sent as (select date, count(*) as n from (select distinct commodity, market_id, variety_key, date, price, quantity from sent) group by 1)
  select a.date, a.n as sent, coalesce(c.n, 0) as kept, case when a.date > last_end - 4 then coalesce(c.n, 0) else 0 end as held
  from all_sent a left join counted c on a.date = c.date, ends"""


@register("stream_late_rows", oracle(_LATE_SQL))
def stream_late_rows(spark, sf):
    """Reports in three batches, the earlier half, the later half, then what was held back: by day sent, kept, and still in state.

    Of the last batch the rows behind the watermark are late and dropped, although their keys are new. At the end the
    state holds only keys that a repeat within the delay could still meet.
    """
    reports = write_and_reload(_as_reports(spark, sf, T.table(spark, sf, "lineitem")), "arriving")
    days = reports.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    half = days.select(F.date_add("first", F.floor(F.datediff("last", "first") / 2).cast("int"))).scalar()
    early = F.col("date") < half
    inbox, outbox, progress = (shared_folder(spark, x) for x in ("inbox", "deduplicated", "progress"))
    for batch in (early & ~F.col("held_back"), ~early & ~F.col("held_back"), F.col("held_back")):
        reports.filter(batch).drop("held_back").write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(reports.drop("held_back").schema).parquet(inbox)
        kept = jobs.deduplicated_stream(arriving, "event_time", "2 days").select(*DUPLICATE_KEY)
        jobs.write_to_end(kept, outbox, progress)
    by_day = lambda frame, name: frame.groupBy("date").agg(F.count("*").alias(name))
    sent = by_day(reports.select(*DUPLICATE_KEY).distinct(), "sent")
    kept = by_day(spark.read.schema(reports.select(*DUPLICATE_KEY).schema).parquet(outbox), "kept")
    held = by_day(jobs.held_keys(spark, progress), "held")
    zero = F.lit(0).cast("long")
    return sent.join(kept, "date", "left").join(held, "date", "left").select(
        "date", "sent", F.coalesce("kept", zero).alias("kept"), F.coalesce("held", zero).alias("held")
    )


@register("stream_market_day", oracle("""
  select cast(ts as date) as date, event_type, count(*) as reports, min(value) as lowest, max(value) as highest,
    cast(sum(cast(value as decimal(18,2))) as double) as total
  from events group by 1, 2"""))
def stream_market_day(spark, sf):
    events = streamed(spark, sf, "events")
    daily = jobs.daily_stream(events.withColumn("ts", utc_instant(F.col("ts"))), "ts", "2 days", ["event_type"], "value")
    folder = shared_folder(spark, "daily")
    jobs.upsert_to_end(daily, folder, shared_folder(spark, "progress"), ["date", "event_type"], [], "update")
    return jobs.current_table(spark, folder, daily.schema).select(
        "date", "event_type", "reports", "lowest", "highest", F.col("total").cast("double").alias("total")
    )


@register("stream_upsert", oracle(f"""
  select market_id, commodity, date, case when day(date) % 3 = 0 then 1 else 0 end as revision,
    case when day(date) % 3 = 0 then {rnd('representative_price + 1', 2)} else representative_price end as representative_price
  from history""", "history"))
def stream_upsert(spark, sf):
    """Market-days arrive first, revisions of every third day later; the later row stays."""
    days = history(spark, sf).select(*HISTORY_KEY, PRICE)
    inbox, folder = shared_folder(spark, "inbox"), shared_folder(spark, "merged")
    days.withColumn("revision", F.lit(0)).write.parquet(inbox)
    days.filter(F.dayofmonth("date") % 3 == 0).withColumn(PRICE, rounded(F.col(PRICE) + 1, 2)).withColumn(
        "revision", F.lit(1)
    ).write.mode("append").parquet(inbox)
    arriving = spark.readStream.schema(spark.read.parquet(inbox).schema).option("maxFilesPerTrigger", 64).parquet(inbox)
    jobs.upsert_to_end(arriving, folder, shared_folder(spark, "progress"), HISTORY_KEY, ["revision"])
    return jobs.current_table(spark, folder, arriving.schema).select(*HISTORY_KEY, "revision", PRICE)
