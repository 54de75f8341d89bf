import json
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bazaarflow.operators import compare as C
from bazaarflow.operators import explore as X
from bazaarflow.queries import load

SMALL = "/root/testdata/sf0.001"
PRICE = "key string, market string, commodity string, source_date date, target_date date, price double, low_price double, high_price double"


def priced(spark, *rows):
    day = date(2026, 1, 2)
    return spark.createDataFrame([(k, m, "Onion", day, t, p, lo, hi) for k, m, t, p, lo, hi in rows], PRICE)


DAY = date(2026, 1, 3)


@pytest.mark.parametrize("quantity, unit, quintals", [(250.0, "kg", 2.5), (2.5, "quintal", 2.5), (1.2, "tonne", 12.0)])
def test_units(spark, quantity, unit, quintals):
    assert spark.range(1).select(C.to_quintals(F.lit(quantity), F.lit(unit))).first()[0] == quintals


@pytest.mark.parametrize("value, method, cost", [(500.0, "total", 500.0), (50.0, "per_quintal", 1000.0), (500.0, "per_tonne", 1000.0)])
def test_transport(spark, value, method, cost):
    assert spark.range(1).select(C.transport_cost(F.lit(value), F.lit(method), F.lit(20.0))).first()[0] == cost


@pytest.mark.parametrize("bad", [-1.0, float("inf"), float("nan")])
def test_bad_quantities_are_errors(spark, bad):
    with pytest.raises(Exception, match="non-negative"):
        spark.range(1).select(C.to_quintals(F.lit(bad), F.lit("kg"))).collect()


def test_net_amounts(spark):
    lot = C.Lot(1.0, "tonne", "total", {"a": 2000.0}, {"a": 500.0})
    row = C.for_lot(priced(spark, ("a", "A", DAY, 2500.0, 2300.0, 2700.0)), lot).first()
    assert (row.gross, row.amount, row.amount_low, row.amount_high) == (25000.0, 22500.0, 20500.0, 24500.0)


def test_lower_price_can_win_on_cost(spark):
    rows = priced(spark, ("high", "H", DAY, 3000.0, 3000.0, 3000.0), ("lower", "L", DAY, 2800.0, 2800.0, 2800.0))
    best = C.ranked(C.for_lot(rows, C.Lot(1.0, "tonne", "total", {"high": 5000.0, "lower": 500.0}))).orderBy("rank").first()
    assert best.key == "lower"


def test_two_target_dates_are_an_error(spark):
    rows = priced(spark, ("a", "A", DAY, 1.0, 1.0, 1.0), ("b", "B", date(2026, 1, 4), 1.0, 1.0, 1.0))
    with pytest.raises(Exception, match="common target date"):
        C.ranked(C.for_lot(rows, C.Lot(1.0))).collect()


def test_csv_has_fixed_decimals_and_quotes(spark, tmp_path):
    results = C.for_lot(priced(spark, ("a", 'Pune, "East"', DAY, 2269.53, 2000.0, 2500.0)), C.Lot(10.0, "quintal"))
    lines = [r.line for r in C.csv_lines(C.csv_rows(results)).collect()]
    assert lines[0].startswith('"Pune, ""East""",2026-01-02,2026-01-03,2269.53') and "22695.30" in lines[0] and ",10.000," in lines[0]
    C.write_csv(C.csv_rows(results), str(tmp_path))
    text = "".join(p.read_text() for p in tmp_path.glob("*.csv"))
    assert len(set(text.splitlines())) == 2 and "22695.30" in text  # every part file has the header


def test_requested_date_is_used_only_when_common(series):
    both = series([1, 2, 3], market="a").unionByName(series([5, 6], market="b"))
    dates = lambda wanted: {r.target_date for r in C.observed_prices(both, 2, wanted).collect()}
    assert dates(None) == {date(2026, 1, 2)} and dates(date(2026, 1, 1)) == {date(2026, 1, 1)}
    assert dates(date(2026, 1, 3)) == {date(2026, 1, 2)}


def test_selection_size():
    C.check_selection(["a", "b"])
    for keys in (["a"], ["a", "a"], list("abcde")):
        with pytest.raises(ValueError):
            C.check_selection(keys)


def test_page_is_clamped(spark):
    rows = [("Onion", f"{i:03d}", f"M{i}", date(2026, 1, 1), float(i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "commodity string, market_id string, market string, last_date date, latest_price double")
    assert [X.page(frame, "price-low", n).count() for n in (1, 3, 99, 0)] == [18, 4, 4, 18]
    assert X.page(frame, "price-high", 1).first().latest_price == 39.0


def test_upper_median_takes_the_upper_middle(spark):
    rows = [("O", date(2026, 1, 1), v) for v in (1.0, 2.0, 2.0, 9.0)] + [("O", date(2026, 1, 2), v) for v in (1.0, 5.0)]
    frame = spark.createDataFrame(rows, "commodity string, date date, representative_price double")
    assert sorted(r.value for r in X.upper_median_by_date(frame).collect()) == [2.0, 5.0]


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    reports, checks = load()
    assert set(reports) == set(checks)  # every query of the reports has an SQL check


def test_entry_returns_rows(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "anomaly_score" in frame.columns


@pytest.mark.parametrize("name", ["market_day", "val_exact_duplicate", "features_origin", "stream_market_day"])
def test_results_do_not_depend_on_partitions(spark, name):
    results = []
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(sorted(map(str, entry.queries()[name](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and results[0]


def test_windows_share_one_exchange(spark, series):
    from bazaarflow.operators import features
    from bazaarflow.settings import DEFAULTS

    frame = features.report_features(series([1, 2, 3]).withColumn("coverage_tier", F.lit("high")), 28)
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    executed = frame._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1 and executed.count("Sort [") == 1, plan


def test_late_rows_are_dropped_and_state_is_released(spark):
    """Rows behind the watermark go even if their keys are new; the state ends with the last days only."""
    days = entry.queries()["stream_late_rows"](spark, "/root/testdata/sf0.001").orderBy("date").collect()
    assert sum(d.sent for d in days) > sum(d.kept for d in days) > 0
    assert all(d.held == 0 for d in days if (days[-1].date - d.date).days >= 4)
    assert 0 < sum(d.held for d in days) <= sum(d.kept for d in days[-4:])


def test_streams_read_folder_tables(spark, tmp_path):
    """A table may be a folder of files; the streams give the same rows as from one file."""
    import os

    for name in os.listdir(SMALL):
        target = tmp_path / name
        if name in ("events.parquet", "lineitem.parquet"):
            spark.read.parquet(f"{SMALL}/{name}").repartition(3).write.parquet(str(target))
        else:
            target.symlink_to(f"{SMALL}/{name}")
    for name in ("stream_market_day", "stream_dedup"):
        query = entry.queries()[name]
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, query(spark, SMALL).collect()), key=str)


def test_a_failed_merge_leaves_the_table_and_replays(spark, tmp_path, monkeypatch):
    from bazaarflow.streaming import jobs

    inbox, folder, progress = (str(tmp_path / n) for n in ("inbox", "table", "progress"))
    rows = lambda *r: spark.createDataFrame(r, "id long, date string, price long").selectExpr("id", "cast(date as date) as date", "price")
    shown = lambda: sorted(tuple(r)[:3] for r in jobs.current_table(spark, folder, rows((0, "2026-01-01", 0)).schema).collect())
    merge = lambda: jobs.upsert_to_end(spark.readStream.schema(rows((0, "2026-01-01", 0)).schema).parquet(inbox), folder, progress, ["id"], [])
    rows((1, "2026-01-01", 10), (2, "2026-02-01", 20)).write.parquet(inbox)
    merge()
    before = shown()
    assert [r[2] for r in before] == [10, 20]
    rows((1, "2026-01-01", 11), (3, "2026-01-09", 30)).write.mode("append").parquet(inbox)
    honest = jobs.switch

    def failing(session, path, batch, version, months):
        if months:
            raise OSError("lost between write and switch")
        honest(session, path, batch, version, months)

    monkeypatch.setattr(jobs, "switch", failing)
    with pytest.raises(Exception, match="lost between"):
        merge()
    assert shown() == before
    monkeypatch.setattr(jobs, "switch", honest)
    merge()
    assert [(r[0], r[2]) for r in shown()] == [(1, 11), (2, 20), (3, 30)]
