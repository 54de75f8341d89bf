"""Clustered store and hashes of files."""

import hashlib
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import files as H
from bazaarflow.operators import store as K

HISTORY = """state string, commodity string, market_id string, date date, min_price double, representative_price double, max_price double, arrivals_tonnes double,
    arrival_coverage string, variety_count long, example_variety string, example_variety_basis string, aggregation_method string, is_anomaly boolean, anomaly_score double"""


@pytest.fixture
def tables(spark):
    start = date(2025, 1, 1)
    days = spark.createDataFrame([
        (state, crop, f"{state[0]}-{m}", start + timedelta(days=d), 1.0, 2.0 + d, 900.0, None, "missing", 1, "Red", "alphabetical fallback", "median of variety modal prices", False, 0.0)
        for state in ("Goa", "Bihar", "São Tomé/X") for crop in ("Onion", "Green Chilli") for m in range(5) for d in range(40)], HISTORY)
    series = days.select("state", "commodity", "market_id").distinct()
    coverage = series.select("*", F.lit(1).cast("long").alias("state_id"), F.lit("M").alias("market"), F.lit("D").alias("district"), F.lit(start).alias("first_date"),
        F.lit(start).alias("last_date"), F.lit(40).cast("long").alias("record_count"), F.lit(0.5).alias("weekly_coverage"), F.lit(1).alias("latest_age_days"),
        F.lit(1).alias("maximum_gap_days"), F.lit(0.123456).alias("price_cv"), F.lit("high").alias("coverage_tier"))
    outlook = series.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("target_offset_days"), F.lit(5.00001).alias("forecast_price"))
    return K.sections(days, coverage, outlook)


def test_detail_opens_only_the_files_of_its_group(spark, tables, tmp_path):
    K.write_store(tables, str(tmp_path))
    every = K.read_table(spark, str(tmp_path), "observations")
    found = K.market_detail(spark, str(tmp_path), "Goa", "Green Chilli", "G-3", since=date(2025, 1, 11))
    assert [r.date.day for r in found.observations.collect()][:2] == [11, 12] and found.observations.count() == 30
    assert [r.target_offset_days for r in found.forecasts.collect()] == list(range(1, 8))
    assert [(r.month, r.median_price, r.observations) for r in found.seasonal.collect()] == [(1, 17.0, 31), (2, 37.0, 9)]
    assert found.market.first()["price_cv"] == 0.1235
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    found = K.market_detail(spark, str(tmp_path), "Goa", "Green Chilli", "G-3", since=date(2025, 1, 11))
    plan = found.observations._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "PartitionFilters: [isnotnull" in plan and "= goa)" in plan and "= green-chilli)" in plan and "EqualTo(market_id,G-3)" in pushed and "GreaterThanOrEqual(date,2025-01-11)" in pushed
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    opened = K.of_group(every, "Goa", "Green Chilli").select("_metadata.file_path").distinct().count()
    assert 0 < opened < len(every.inputFiles())


def test_files_are_bounded_and_rows_return_in_any_form(spark, tables, tmp_path):
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for form in ("parquet", "json"):
        K.write_store(tables, f"{tmp_path}/{form}", form)
        for name, frame in tables.items():
            back = K.read_table(spark, f"{tmp_path}/{form}", name, form, frame.schema if form == "json" else None).select(frame.columns)
            assert len(back.inputFiles()) <= 6 + ranges
            assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    K.write_store(tables, f"{tmp_path}/small", rows_per_file=50)
    assert len(K.read_table(spark, f"{tmp_path}/small", "observations").inputFiles()) >= 24


def test_detail_of_an_unknown_market_and_of_an_odd_name(spark, tables, tmp_path):
    K.write_store(tables, str(tmp_path))
    assert K.market_detail(spark, str(tmp_path), "Goa", "Onion", "nowhere").rows().count() == 0
    odd = K.market_detail(spark, str(tmp_path), "São Tomé/X", "Onion", "S-0").rows()
    assert {r["part"]: r["count"] for r in odd.groupBy("part").count().collect()} == {"market": 1, "observations": 40, "forecasts": 7, "seasonal": 2}


def test_file_hashes_of_any_size(spark, tmp_path):
    contents = {"a.bin": b"", "b.bin": b"x" * 100, "deep/c.bin": bytes(range(256)) * 40, "deep/d.bin": b"y" * 300, "e.txt": b"no"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    found = {r.path.split(tmp_path.name + "/")[1]: r for r in H.file_ledger(spark, str(tmp_path), "*.bin", 100).collect()}
    assert set(found) == {"b.bin", "deep/c.bin", "deep/d.bin"}  # scans leave out empty files
    for name, row in found.items():
        data = contents[name]
        parts = [sha(data[i : i + 100]) for i in range(0, len(data), 100)]
        assert (row.bytes, row.ranges, row.sha256) == (len(data), len(parts), parts[0] if len(parts) == 1 else sha("".join(parts).encode()))


def test_ledger_reads_no_content_of_large_files_in_the_scan(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"z" * 1000)
    plan = H.file_ledger(spark, str(tmp_path), "*", 100)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
    assert len(scans) == 2 and "LessThanOrEqual(length,100)" in scans[0] and "content" not in scans[1].split("ReadSchema")[1]


def test_partition_hash_depends_on_content_only(spark, tables, tmp_path):
    hashes = []
    for run in ("a", "b"):
        K.write_store({"seasonal": tables["seasonal"]}, f"{tmp_path}/{run}", "json")
        hashes.append(sorted(map(tuple, H.partition_ledger(spark, f"{tmp_path}/{run}/seasonal", K.FOLDERS).collect())))
    assert hashes[0] == hashes[1] and len(hashes[0]) == 6 and all(row[2] > 0 for row in hashes[0])
    changed = tables["seasonal"].withColumn("median_price", F.when((F.col("state") == "Goa") & (F.col("commodity") == "Onion"), 1.0).otherwise(F.col("median_price")))
    K.write_store({"seasonal": changed}, f"{tmp_path}/c", "json")
    other = sorted(map(tuple, H.partition_ledger(spark, f"{tmp_path}/c/seasonal", K.FOLDERS).collect()))
    assert sum(a != b for a, b in zip(hashes[0], other)) == 1
