"""Change detection, ledger merge and the refresh as one job."""

from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from bazaarflow import session
from bazaarflow.operators.upsert import changed_keys, content_hashes
from bazaarflow.plans import refresh
from bazaarflow.queries.reports import _by_month
from bazaarflow.settings import DEFAULTS

REPORT = """line long, state_id long, state string, district string, market_id string, market string, commodity string, variety string, date date,
    min_price double, max_price double, modal_price double, arrivals_tonnes double, source_month string"""
QUALITY = replace(DEFAULTS.quality, start_date=date(2025, 1, 1), end_date=date(2025, 12, 31), minimum_records=10)


def reports(spark, days=range(150), price=lambda d, m: 100.0 + d % 7, crops=("Onion", "Chilli")):
    start, rows = date(2025, 1, 1), []
    for crop in crops:
        for m in range(2):
            for d in days:
                day = start + timedelta(days=d)
                p = price(d, m)
                rows.append((len(rows), 20, "S", "D", f"20-{m}", f"M{m}", crop, "Red", day, p - 1, p + 1, p, 2.0 + d, day.strftime("%Y-%m")))
    return spark.createDataFrame(rows, REPORT)


def stored(spark, frame, folder):
    frame.write.partitionBy("source_month").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def nothing(spark):
    return spark.createDataFrame([], "state_id long, state string, commodity string, source_month string, source_sha256 string")


def test_hashes_follow_content_not_order(spark):
    frame = reports(spark, range(40))
    hashed = lambda f: {tuple(r)[:-1]: r[-1] for r in content_hashes(f, ["commodity", "source_month"], refresh.CONTENT).collect()}
    first = hashed(frame)
    assert first == hashed(frame.orderBy(F.desc("line")).repartition(5)) and len(first) == 4
    other = hashed(frame.withColumn("modal_price", F.when(F.col("line") == 3, None).otherwise(F.col("modal_price"))))
    assert [k for k in first if first[k] != other[k]] == [("Onion", "2025-01")]
    twice = hashed(frame.unionByName(frame.filter("line = 3")))
    assert [k for k in first if first[k] != twice[k]] == [("Onion", "2025-01")]


def test_changed_keys(spark):
    make = lambda *rows: spark.createDataFrame(rows, "state_id long, commodity string, source_month string, source_sha256 string")
    before = make((1, "a", "m", "x"), (1, "b", "m", "x"), (1, "gone", "m", "x"), (1, "unhashed", "m", None))
    after = make((1, "a", "m", "x"), (1, "b", "m", "y"), (1, "new", "m", "x"), (1, "unhashed", "m", "x"))
    assert sorted(r.commodity for r in changed_keys(before, after).collect()) == ["b", "new", "unhashed"]


def test_only_changed_months_are_read_and_the_ledger_keeps_the_rest(spark, tmp_path):
    first = stored(spark, reports(spark), f"{tmp_path}/first")
    ledger = refresh.changes(first, nothing(spark), ["line"], QUALITY).ledger
    assert ledger.count() == 10 and ledger.agg(F.sum("input_records")).first()[0] == 600
    current = reports(spark).withColumn("modal_price", F.when((F.col("source_month") == "2025-03") & (F.col("commodity") == "Onion"), -1.0).otherwise(F.col("modal_price")))
    second = stored(spark, current.filter("source_month <> '2025-01'"), f"{tmp_path}/second")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    hashes = content_hashes(second, ["state", "state_id", "commodity", "source_month"], refresh.CONTENT)
    plans = []
    honest = refresh.V.validated
    refresh.V.validated = lambda frame, *rest: (plans.append(frame._jdf.queryExecution().executedPlan().toString()), honest(frame, *rest))[1]
    try:
        found = refresh.changes(second, ledger, ["line"], QUALITY, hashes)
    finally:
        refresh.V.validated = honest
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(source_month" in plans[0] and "(source_month#" in plans[0] and "= 2025-03)" in plans[0]
    assert {r["source_month"] for r in found.marked.select("source_month").distinct().collect()} == {"2025-03"}
    rows = {(r.commodity, r.source_month): r for r in found.ledger.collect()}
    assert len(rows) == 10 and rows["Onion", "2025-03"].excluded_records == 62 and rows["Chilli", "2025-03"].excluded_records == 0
    assert rows["Onion", "2025-01"].accepted_records == 62  # its file is gone, its ledger row stays
    assert found.rejected().count() == 62
    again = refresh.changes(second, found.ledger, ["line"], QUALITY)
    assert again.sources.isEmpty() and sorted(map(tuple, again.ledger.select(rows["Onion", "2025-01"].__fields__).collect())) == sorted(map(tuple, found.ledger.collect()))


def test_refresh_writes_everything_and_stops_without_series(spark, tmp_path):
    first = stored(spark, reports(spark, range(100)), f"{tmp_path}/first")
    base = refresh.changes(first, nothing(spark), ["line"], QUALITY)
    published = f"{tmp_path}/published"
    days = refresh.merged_history(refresh.market_days(refresh.V.split(base.marked)[0].limit(0), deduplicated=True),
                                  refresh.market_days(refresh.V.split(base.marked)[0], deduplicated=True), QUALITY)
    days.write.parquet(f"{published}/all_market_history")
    base.ledger.write.parquet(f"{published}/source_quality_ledger")
    second = stored(spark, reports(spark, price=lambda d, m: -5.0 if d == 120 else 100.0 + d % 7), f"{tmp_path}/second")
    target = f"{tmp_path}/next"
    refresh.refresh_all(spark, published, second, ["line"], QUALITY, target)
    read = lambda name: spark.read.parquet(f"{target}/{name}")
    assert read("all_market_history").count() == 4 * 149 and read("rejected_records").count() == 4
    assert read("source_quality_ledger").agg(F.sum("input_records"), F.sum("excluded_records")).first() == (600, 4)
    assert read("market_coverage").count() == 4 and read("market_history").count() == 4 * 149
    with pytest.raises(RuntimeError, match="coverage rules"):
        refresh.refresh_all(spark, published, second, ["line"], replace(QUALITY, minimum_records=10_000), f"{tmp_path}/never")
    assert not (tmp_path / "never").exists()


def test_sources_are_dealt_by_month_without_a_sample(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"2024-{i % 12 + 1:02}") for i in range(600)], "at int, source_month string")
    dealt = _by_month(frame)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_month" in plan and "REBALANCE_PARTITIONS_BY_COL" in plan and "rangepartitioning" not in plan
    dealt.write.partitionBy("source_month").parquet(str(tmp_path / "months"))
    assert sorted(r.at for r in spark.read.parquet(str(tmp_path / "months")).collect()) == list(range(600))
    assert sorted(f.name for f in (tmp_path / "months").iterdir() if f.is_dir()) == [f"source_month=2024-{m:02}" for m in range(1, 13)]


def test_copies_are_found_whatever_the_number_of_passes(spark, monkeypatch):
    """Each pass shuffles a part of the reports; copies, null keys and rejected reports are those of a single pass."""
    frame = reports(spark, range(60))
    odd = frame.filter("line % 9 = 0").withColumn("variety", F.lit(None).cast("string"))
    frame = frame.unionByName(odd.withColumn("line", F.col("line") + 1000)).unionByName(odd.withColumn("line", F.col("line") + 2000))
    copies = frame.filter("line % 4 = 0").withColumns({"line": F.col("line") + 10_000, "variety": F.upper("variety")})
    frame = frame.unionByName(copies).withColumn("min_price", F.when(F.col("line") % 11 == 0, -1.0).otherwise(F.col("min_price")))

    def found(rows, most):
        monkeypatch.setattr(session, "PASS_ROWS", rows)
        monkeypatch.setattr(session, "PASSES", most)
        result = refresh.changes(frame, nothing(spark), ["line"], QUALITY)
        return sorted((r.line, r.exclusion_reason or "") for r in result.marked.collect()), sorted(map(str, result.ledger.collect()))

    stored_by = []
    write = refresh.write_passes
    monkeypatch.setattr(refresh, "write_passes", lambda frames, purpose: stored_by.append([f.count() for f in frames]) or write(frames, purpose))
    whole, parts = found(10**9, 1), found(50, 5)
    assert whole == parts and {r for _, r in whole[0]} == {"", "exact_duplicate", "non_positive_price"}
    assert [len(n) for n in stored_by] == [1, 5] and sum(stored_by[1]) == sum(stored_by[0]) == frame.count()
    assert max(stored_by[1]) < frame.count() / 2


def test_source_versions_store_the_reports_once_and_leave_no_shuffles(spark, tmp_path, monkeypatch):
    from bazaarflow.queries import reports as queries

    start = date(2001, 1, 1)
    lines = [(i, i % 5, i % 3, i % 7 + 1, 10.0, 100.0 + i, 0.01, 0.02, "N", start + timedelta(days=i % 90)) for i in range(300)]
    spark.createDataFrame(lines, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_shipdate date""").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, ("PROMO", "SMALL", "LARGE")[i % 3], f"B{i}") for i in range(5)], "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, i) for i in range(3)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    monkeypatch.setattr(session, "PASS_ROWS", 100)
    folders, freed = [], []
    folder, dealt = session.shared_folder, queries._by_month
    noted = lambda spark, purpose: folders.append(purpose) or folder(spark, purpose)
    monkeypatch.setattr(session, "shared_folder", noted)
    monkeypatch.setattr(queries, "shared_folder", noted)
    monkeypatch.setattr(queries, "_by_month", lambda rows: freed.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or dealt(rows))
    current, ledger = queries._source_versions(spark, str(tmp_path))
    # PROMO from 2001 on is not in the earlier sources, SMALL before 1996 isn't there at all
    assert current.count() == 306 and ledger.agg(F.sum("input_records")).first()[0] == current.filter("commodity <> 'PROMO'").count()
    assert folders.count("sources") == 1 and freed == ["true"] * 3
