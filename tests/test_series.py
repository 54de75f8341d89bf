from dataclasses import replace
from datetime import date, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import coverage as C
from bazaarflow.operators import series as S
from bazaarflow.operators import upsert as U
from bazaarflow.plans import refresh
from bazaarflow.settings import DEFAULTS

QUALITY = DEFAULTS.quality


def brute_scores(prices):
    out = []
    for i, price in enumerate(prices):
        window = prices[max(0, i - 30):i]
        score = 0.0
        if len(window) >= 8:
            center = median(window)
            scale = max(1.4826 * median(abs(v - center) for v in window), center * 0.03, 1.0)
            score = (price - center) / scale
        out.append((round(score, 4), abs(score) >= 4))
    return out


def test_anomaly_against_brute_force(series):
    prices = [100 + (i * 7919) % 23 + (400 if i in (40, 41) else 0) for i in range(70)]
    rows = S.with_anomaly(series(prices)).orderBy("date").collect()
    for row, (score, flag) in zip(rows, brute_scores(prices)):
        assert row.anomaly_score == pytest.approx(score, abs=1e-4) and row.is_anomaly == flag
    assert rows[40].is_anomaly and not rows[7].is_anomaly


def test_asof_falls_back_to_the_first_price(series):
    frame = series([10, 20, 30], step=5).select("date", S.asof(7).alias("p"), S.asof(5).alias("q")).orderBy("date")
    assert [(r.p, r.q) for r in frame.collect()] == [(10.0, 10.0), (10.0, 10.0), (10.0, 20.0)]


def test_calendar_frames_include_both_ends(series):
    last = series([10, 20, 30], step=7).select("date", S.mean_of_last(7).alias("m")).orderBy(F.desc("date")).first()
    assert last.m == 25.0


def test_history_range_is_relative_to_the_last_report(spark):
    days = [(("Onion"), "1", d) for d in (date(2025, 1, 1), date(2025, 12, 31), date(2026, 1, 2))]
    frame = spark.createDataFrame(days, "commodity string, market_id string, date date")
    assert S.within_range(frame, 90).count() == 2
    assert S.within_range(frame, None).count() == 3


def test_missing_days(spark):
    frame = spark.createDataFrame([("O", "1", date(2026, 1, 1)), ("O", "1", date(2026, 1, 3)), ("O", "2", date(2026, 1, 3))], "commodity string, market_id string, date date")
    assert {r.market_id: r.missing_days for r in S.missing_days(frame).collect()} == {"1": 1, "2": 0}


def test_sampling_keeps_the_last_point_and_anomalies(series):
    frame = series(range(1, 501)).withColumn("is_anomaly", F.col("representative_price") == 2)
    kept = [r.representative_price for r in S.systematic_sample(frame, 40, keep_anomalies=True).orderBy("date").collect()]
    assert len(kept) < 50 and kept[-1] == 500.0 and 2.0 in kept
    assert S.systematic_sample(series(range(1, 31)), 40).count() == 30


def test_calendar_marks_reported_days(series):
    rows = S.calendar(series([1, 2, 3], step=2), 6).orderBy("date").collect()
    assert [r.reported for r in rows] == [False, True, False, True, False, True]


def test_coverage_of_one_report(series):
    row = C.series_coverage(series([5]), QUALITY).first()
    assert (row.record_count, row.weekly_coverage, row.maximum_gap_days, row.price_cv, row.repeated_price_share) == (1, 1.0, 0, 0.0, 1.0)
    assert not row.eligible


def test_coverage_counts_weeks_and_gaps(series):
    row = C.series_coverage(series([10, 10, 20], start=date(2026, 1, 5), step=14), QUALITY).first()
    assert (row.weeks_reported, row.weekly_coverage, row.maximum_gap_days) == (3, 0.6, 14)
    assert row.repeated_price_share == 0.6667 and row.coverage_tier == "standard"


def test_best_series_per_group(series):
    quality = replace(QUALITY, minimum_records=1, minimum_weekly_coverage=0.0, maximum_age_days=99)
    frame = series(range(1, 11), market="a").unionByName(series(range(1, 6), market="b")).unionByName(series(range(1, 6), market="c"))
    covered = C.series_coverage(frame, quality)
    # equal weekly coverage: more records first, then the newer, then the market id
    assert [r.market_id for r in C.selected_series(covered, 2).orderBy("selection_rank").collect()] == ["a", "b"]
    assert {r.market_id: r.selected for r in C.with_selected(covered, 1).collect()} == {"a": True, "b": False, "c": False}


def test_refreshed_rows_replace_published_ones(series):
    old, new = series([1, 2, 3]), series([9, 9], start=date(2026, 1, 3))
    merged = U.keep_last(old, new)
    assert [r.representative_price for r in merged.orderBy("date").collect()] == [1.0, 2.0, 9.0, 9.0]
    assert U.repeated_keys(merged).isEmpty()
    again = U.keep_last(merged, new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_merge_scores_the_whole_history(series):
    quality = replace(QUALITY, history_days=400)
    merged = refresh.merged_history(S.with_anomaly(series([100] * 20)), series([900], start=date(2026, 1, 21)), quality)
    assert merged.orderBy(F.desc("date")).first().is_anomaly


def test_flags_survive_later_merges(series):
    quality = replace(QUALITY, history_days=30)
    prices = [100.0] * 20 + [400.0] + [100.0] * 9
    published = refresh.merged_history(series([100.0]), series(prices, start=date(2026, 1, 2)), quality)
    flagged = date(2026, 1, 22)
    for week in range(2):
        known = {r.date: (r.anomaly_score, r.is_anomaly) for r in published.collect()}
        assert known[flagged] == (100.0, True)
        published = refresh.merged_history(published, series([100.0] * 7, start=date(2026, 2, 1) + timedelta(days=7 * week)), quality)
        merged = {r.date: (r.anomaly_score, r.is_anomaly) for r in published.collect()}
        assert len(merged) == 30 and all(merged[d] == known[d] for d in merged if d in known)


def test_publication_is_written_and_covers_less_than_all(series, tmp_path, spark):
    quality = replace(QUALITY, minimum_records=5, minimum_weekly_coverage=0.1, maximum_age_days=30, series_per_group=1)
    frame = S.with_anomaly(series(range(10, 30), market="a").unionByName(series(range(10, 20), market="b")))
    result = refresh.refreshed(frame, quality)
    refresh.write_refreshed(result, str(tmp_path))
    published = spark.read.parquet(f"{tmp_path}/market_history")
    assert published.select("market_id").distinct().count() == 1
    assert spark.read.parquet(f"{tmp_path}/all_market_history").count() == 30 > published.count()
