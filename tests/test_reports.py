from datetime import date

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import validate as V
from bazaarflow.operators.market_day import market_days
from bazaarflow.plans import refresh
from bazaarflow.settings import DEFAULTS

START, END, CEILING = date(2024, 7, 1), date(2026, 7, 20), 250_000.0


def test_weighted_when_every_arrival_is_reported(reports):
    day = market_days(reports(("Local", 80.0, 140.0, 100.0, 2.0), ("Red", 150.0, 240.0, 200.0, 6.0))).first()
    assert (day.representative_price, day.arrivals_tonnes, day.min_price, day.max_price) == (175.0, 8.0, 80.0, 240.0)
    assert (day.arrival_coverage, day.example_variety, day.variety_count) == ("complete", "Red", 2)


def test_median_without_arrivals(reports):
    day = market_days(reports(("Other", 80.0, 140.0, 100.0, None), ("Local", 150.0, 240.0, 200.0, None))).first()
    assert (day.representative_price, day.arrivals_tonnes, day.arrival_coverage, day.example_variety) == (150.0, None, "missing", "Local")


def test_partial_arrivals_are_not_weights(reports):
    day = market_days(reports(("Local", 80.0, 140.0, 100.0, None), ("Other", 150.0, 240.0, 200.0, 6.0))).first()
    assert (day.representative_price, day.arrival_coverage, day.example_variety) == (150.0, "partial", "Other")


def test_zero_arrivals_fall_back_to_the_median_but_count_as_complete(reports):
    day = market_days(reports(("A", 1.0, 3.0, 1.0, 0.0), ("B", 1.0, 3.0, 3.0, 0.0), ("C", 1.0, 3.0, 3.0, 0.0))).first()
    assert (day.representative_price, day.arrival_coverage, day.arrivals_tonnes) == (3.0, "complete", 0.0)
    assert day.aggregation_method.startswith("median")


def test_reasons_follow_their_order(reports, spark):
    good = ("V", 10.0, 12.0, 11.0, 1.0)
    cases = [
        (good, {}, None),
        (good, {"market": "", "date": date(2020, 1, 1)}, "missing_identity_or_invalid_date"),
        (good, {"date": None}, "missing_identity_or_invalid_date"),
        (good, {"date": date(2020, 1, 1), "min_price": None}, "outside_requested_date_range"),
        (good, {"modal_price": None, "min_price": -1.0}, "unparseable_price"),
        (good, {"min_price": 0.0, "max_price": 300_000.0}, "non_positive_price"),
        (good, {"max_price": 250_001.0, "modal_price": 1.0}, "price_above_safety_ceiling"),
        (good, {"modal_price": 13.0, "arrivals_tonnes": -1.0}, "invalid_price_order"),
        (good, {"arrivals_tonnes": -1.0}, "negative_arrivals"),
    ]
    for row, changes, reason in cases:
        frame = reports(row)
        for column, value in changes.items():
            frame = frame.withColumn(column, F.lit(value).cast(frame.schema[column].dataType))
        assert V.validated(frame, START, END, CEILING).first()[V.REASON] == reason


def test_bounds_of_the_range_are_inside(reports):
    for day in (START, END):
        assert V.validated(reports(("V", 1.0, 1.0, 1.0, None)).withColumn("date", F.lit(day)), START, END, CEILING).first()[V.REASON] is None


def placed(reports, *rows):
    from pyspark.sql import Window

    frame = reports(*rows).withColumn("at", F.monotonically_increasing_id())
    return V.validated(frame, START, END, CEILING)


def test_duplicates_ignore_arrivals_and_case_and_keep_the_first(reports):
    frame = placed(reports, ("Red", 1.0, 3.0, 2.0, 5.0), ("RED", 1.0, 3.0, 2.0, 9.0), ("Red", 1.0, 3.0, 2.5, 5.0), ("Red", 3.0, 1.0, 2.0, 1.0))
    marked = {r.at: r[V.REASON] for r in V.with_duplicates_marked(frame, ["at"]).collect()}
    assert sorted(marked.values(), key=str) == [None, None, "exact_duplicate", "invalid_price_order"]
    kept = V.first_copies(frame, ["at"]).collect()
    assert sorted((r.modal_price, r.arrivals_tonnes) for r in kept) == [(2.0, 5.0), (2.5, 5.0)]


def test_a_rejected_row_does_not_hide_a_later_equal_one(reports):
    frame = placed(reports, ("Red", 1.0, 3.0, 2.0, -1.0), ("Red", 1.0, 3.0, 2.0, 5.0))
    assert [r[V.REASON] for r in V.with_duplicates_marked(frame, ["at"]).orderBy("at").collect()] == ["negative_arrivals", None]


def test_a_third_of_all_rows_may_be_one_report(reports, spark):
    """Copies of one report and one hot market-day stay exact."""
    hot = spark.range(3000).select(
        F.lit(20).cast("long").alias("state_id"), F.lit("S").alias("state"), F.lit("D").alias("district"),
        F.when(F.col("id") < 2000, "20-1").otherwise(F.concat(F.lit("20-"), F.col("id").cast("string"))).alias("market_id"),
        F.lit("M").alias("market"), F.lit("Onion").alias("commodity"), F.lit("Red").alias("variety"),
        F.lit(date(2026, 7, 1)).alias("date"), F.lit(1.0).alias("min_price"), F.lit(9000.0).alias("max_price"),
        F.when(F.col("id") < 1000, 2.0).otherwise(F.col("id").cast("double")).alias("modal_price"),
        F.lit(None).cast("double").alias("arrivals_tonnes"), F.col("id").alias("at"),
    )
    checked = V.validated(hot, START, END, CEILING)
    assert V.with_duplicates_marked(checked, ["at"]).filter(F.col(V.REASON).isNotNull()).count() == 999
    days = {r.market_id: r for r in market_days(V.first_copies(checked, ["at"]), deduplicated=True).collect()}
    assert len(days) == 1001
    # 2.0 once and 1000..1999
    assert days["20-1"].representative_price == 1499.0


def test_accepted_and_rejected_add_up(reports):
    frame = placed(reports, ("A", 1.0, 3.0, 2.0, 5.0), ("A", 1.0, 3.0, 2.0, 9.0), ("B", 3.0, 1.0, 2.0, 1.0))
    accepted, rejected = V.split(V.with_duplicates_marked(frame, ["at"]))
    assert accepted.count() + rejected.count() == frame.count() == 3


def test_ledger_lists_files_without_rows(reports, spark):
    marked = V.with_duplicates_marked(placed(reports, ("A", 1.0, 3.0, 2.0, 5.0), ("A", 1.0, 3.0, 2.0, 9.0)), ["at"]).withColumn("source_month", F.lit("2026-07"))
    files = spark.createDataFrame([(20, "2026-07"), (20, "2026-08")], "state_id long, source_month string")
    rows = {r.source_month: r for r in V.quality_ledger(marked, files, ["state_id", "source_month"]).collect()}
    assert rows["2026-07"].exclusion_reasons_json == '{"exact_duplicate":1}'
    assert (rows["2026-08"].input_records, rows["2026-08"].exclusion_reasons_json) == (0, "{}")
    total = V.cumulative_quality(V.quality_ledger(marked, files, ["state_id", "source_month"])).first()
    assert total.reconciles and total.input_records == 2


def test_both_ways_of_rolling_up_agree(reports):
    frame = reports(("A", 1.0, 3.0, 2.0, 5.0), ("B", 1.0, 4.0, 2.0, None), ("B", 0.5, 4.0, 2.5, 1.0), ("C", 1.0, 3.0, 2.5, 5.0))
    assert market_days(frame).collect() == market_days(frame, deduplicated=True).collect()


def test_no_accepted_rows_is_an_error(reports):
    from bazaarflow.operators.market_day import require_rows

    with pytest.raises(RuntimeError):
        require_rows(reports(("A", 1.0, 1.0, 1.0, None)).filter("false"), "nothing was accepted")


def test_two_spellings_of_a_market_keep_one_row_per_day(reports):
    days = market_days(reports(("A", 1.0, 3.0, 2.0, 5.0)).unionByName(
        reports(("A", 1.0, 3.0, 3.0, 5.0)).withColumn("market", F.lit("Other spelling"))))
    assert days.count() == 2 and refresh.one_row_per_day(days).count() == 1


def test_accepted_history_runs_end_to_end(reports):
    frame = reports(("A", 1.0, 3.0, 2.0, 5.0)).withColumn("at", F.lit(1))
    assert refresh.accepted_history(frame, ["at"], DEFAULTS.quality).first().representative_price == 2.0
