"""A measured publication finds planted violations without a second scan."""

from datetime import date, timedelta

import json

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import store as K
from bazaarflow.plans import evidence as E
from bazaarflow.settings import DEFAULTS

from test_store import HISTORY  # the published columns


@pytest.fixture
def parts(spark):
    start, method = date(2025, 1, 1), E.METHODS[1]
    rows = [("Goa", crop, f"1-{m}", start + timedelta(days=d), 1.0, 2.0, 3.0, None, "missing", 1, "Red", "alphabetical fallback", method, False, 0.0)
            for crop in ("Onion", "Chilli") for m in range(3) for d in range(30)]
    days = spark.createDataFrame(rows, HISTORY)
    window = days.unionByName(days.limit(5).withColumn("market_id", F.lit("unselected")))
    series = days.select("state", "commodity", "market_id").distinct()
    number = lambda v, name: F.lit(v).cast("long").alias(name)
    coverage = series.select("*", number(1, "state_id"), F.lit("M").alias("market"), F.lit("D").alias("district"), F.lit(start).alias("first_date"),
        F.lit(start).alias("last_date"), number(30, "record_count"), F.lit(0.5).alias("weekly_coverage"), number(9, "latest_age_days"),
        number(1, "maximum_gap_days"), F.lit(0.1).alias("price_cv"), F.lit("high").alias("coverage_tier"))
    outlook = series.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("target_offset_days")).select(
        "*", F.lit(date(2025, 2, 1)).alias("comparison_date"), F.date_add(F.lit(date(2025, 2, 1)), F.col("target_offset_days").cast("int")).alias("forecast_date"),
        F.lit(2.0).alias("forecast_price"), F.lit(1.0).alias("forecast_low"), F.lit(3.0).alias("forecast_high"), F.lit("moving_average").alias("method"))
    partitions = days.groupBy("state", "commodity").agg(F.count("*").alias("observation_count")).select("*", F.lit("goa").alias("state_slug"), F.lower("commodity").alias("commodity_slug"))
    ledger = spark.createDataFrame([(10, 8, 2), (5, 5, 0)], "input_records long, accepted_records long, excluded_records long")
    return days, coverage, outlook, window, ledger, partitions


def failing(spark, folder, days, coverage, outlook, window, ledger, partitions):
    published = E.publish(days, coverage, outlook, "moving_average", 7, DEFAULTS.quality, folder)
    rows = E.invariants(published, window, ledger, partitions).collect()
    assert len(rows) == 17
    return published, {r["check"]: r["measured"] for r in rows if not r["holds"]}


def test_sound_publication(spark, parts, tmp_path):
    published, bad = failing(spark, str(tmp_path / "a"), *parts)
    assert bad == {}
    # ranges sample the rows first; measures count them once
    assert published.found["observations"]["records"] == 180 and published.found["markets"]["stale_series"] == 6
    manifest = E.partition_manifest(spark, published, parts[-1])
    sizes = {p: sum(f.stat().st_size for f in (tmp_path / "a").glob(f"*/state_slug=goa/commodity_slug={p}/part-*")) for p in ("onion", "chilli")}
    assert {r.commodity_slug: r.bytes for r in manifest.collect()} == sizes
    state = E.state_bytes(manifest).first()
    assert (state.partitions, state.observation_count, state.bytes) == (2, 180, sum(sizes.values()))
    E.write_bundle(E.bundle(published, parts[3], parts[4], parts[4], E.invariants(published, *parts[3:]), manifest, "moving_average"), str(tmp_path / "evidence"))
    texts = list((tmp_path / "evidence").glob("part-*"))
    found = json.loads(texts[0].read_text())
    assert len(texts) == 1 and found["quality"]["cumulative_validation"]["input_records"] == 15 and found["quality"]["published"]["records"] == 180
    assert all(c["holds"] for c in found["checks"]) and "source_file" not in texts[0].read_text().replace("source_file_count", "")


def test_planted_violations_are_measured(spark, parts, tmp_path):
    days, coverage, outlook, window, ledger, partitions = parts
    first = (F.col("date") == date(2025, 1, 1)) & (F.col("market_id") == "1-0")
    spoiled = days.withColumn("min_price", F.when(first, 0.0).otherwise(2.5)).withColumn("aggregation_method", F.when(first, "guess").otherwise(F.col("aggregation_method")))
    spoiled = spoiled.unionByName(spoiled.filter(first))
    shifted = outlook.withColumn("forecast_low", F.when(F.col("target_offset_days") == 3, 9.0).otherwise(1.0)).filter("not (market_id = '1-2' and target_offset_days = 7)")
    shifted = shifted.withColumn("forecast_date", F.when((F.col("target_offset_days") == 2) & (F.col("market_id") == "1-1"), F.lit(date(2026, 1, 1))).otherwise(F.col("forecast_date")))
    broken = ledger.withColumn("excluded_records", F.lit(1).cast("long"))  # off by one each way
    _, bad = failing(spark, str(tmp_path), spoiled, coverage, shifted, window, broken, partitions)
    assert bad == {
        "prices_are_positive": 4, "low_is_not_above_price": 178, "methods_are_known": 4, "days_are_unique": 2, "forecast_is_not_below_its_low": 6,
        "every_series_has_all_offsets": 2, "one_date_for_each_offset": 1, "ledger_adds_up": 2, "partitions_add_up": -2,
    }
