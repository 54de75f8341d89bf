from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import evaluate as E
from bazaarflow.operators import features as X
from bazaarflow.operators import intervals as I
from bazaarflow.operators import model as M
from bazaarflow.operators.quantiles import exact_quantiles, rolled_quantiles
from bazaarflow.settings import DEFAULTS

MODEL = DEFAULTS.model


def training(frame):
    return X.training_rows(frame.withColumn("coverage_tier", F.lit("high")), MODEL)


def test_baselines_of_a_rising_series(series):
    row = training(series(range(100, 200, 10))).filter("lead_days = 1").first()
    assert (row.current_price, row.baseline_moving_average, row.target) == (180.0, 160.0, 190.0)
    assert (row.baseline_last, row.reporting_gap_days, row.reports_30d, row.data_age_days) == (180.0, 1, 9, 0)


def test_a_future_price_changes_only_the_target(series):
    prices = list(range(100, 300, 10))
    before = training(series(prices)).filter(F.col("origin_date") < date(2026, 1, 19))
    after = training(series(prices[:-1] + [9999])).filter(F.col("origin_date") < date(2026, 1, 19))
    known = [c for c in before.columns if c != "target"]
    assert sorted(map(str, before.select(*known).collect())) == sorted(map(str, after.select(*known).collect()))
    assert before.select("target").exceptAll(after.select("target")).count() > 0


def test_series_below_nine_reports_give_no_origin(series):
    assert training(series(range(10, 18))).count() == 0
    assert X.forecast_rows(series(range(10, 18)).withColumn("coverage_tier", F.lit("high")), MODEL).count() == 0


def test_forecasts_share_their_target_dates(series):
    both = series(range(10, 22), market="new").unionByName(series(range(10, 20), market="old"))
    rows = X.forecast_rows(both.withColumn("coverage_tier", F.lit("high")), replace(MODEL, horizon_days=3)).collect()
    found = {m: sorted((r.target_date, r.lead_days) for r in rows if r.market_id == m) for m in ("new", "old")}
    targets = [date(2026, 1, 13) + timedelta(days=i) for i in range(3)]
    assert found["new"] == list(zip(targets, (1, 2, 3))) and found["old"] == list(zip(targets, (3, 4, 5)))


def test_a_stale_series_gets_no_forecast(series):
    both = series(range(10, 50), market="new").unionByName(series(range(10, 20), market="old"))
    rows = X.forecast_rows(both.withColumn("coverage_tier", F.lit("high")), MODEL)
    assert {r.market_id for r in rows.collect()} == {"new"}


def test_latest_target_matches_the_training_rows(series):
    frame = series(range(10, 40)).unionByName(series(range(10, 25), market="late", start=date(2026, 3, 1), step=29))
    expected = training(frame).agg(F.max("target_date")).first()[0]
    assert frame.limit(1).select(X.latest_target_date(frame, MODEL)).first()[0] == expected


PREDICTION = (
    "phase string, fold_index long, state string, commodity string, market_id string, market string, lead_days long, "
    "volatility_bucket string, target_date date, actual double, current_price double, rolling_mean_7d double, method string, prediction double"
)


def prediction(method, value, actual, lead=1, day=0, market="1", current=100.0, mean7=100.0, bucket="stable", fold=0):
    return ("model_selection", fold, "S", "Onion", market, "M", lead, bucket, date(2026, 1, 1) + timedelta(days=day), actual, current, mean7, method, value)


def test_metrics(spark):
    frame = spark.createDataFrame([prediction("last_observation", 105.0, 110.0), prediction("last_observation", 95.0, 90.0, day=1)], PREDICTION)
    row = E.method_comparison(frame).first()
    assert (row.n, row.mae, row.directional_accuracy, row.wape) == (2, 5.0, 1.0, 0.05)
    assert row.label == "Last observation"


def test_methods_rank_by_error_then_in_declared_order(spark):
    frame = spark.createDataFrame([prediction(m, v, 10.0) for m, v in (("seasonal_naive", 11.0), ("last_observation", 11.0), ("moving_average", 10.5))], PREDICTION)
    assert [r.method for r in E.method_comparison(frame).collect()] == ["moving_average", "last_observation", "seasonal_naive"]


def test_blend_search_finds_the_exact_weight(spark):
    frame = spark.createDataFrame([(35.0, 0.0, 100.0, 25.0, 25.0, 1)], "actual double, base double, tree double, current_price double, rolling_mean_7d double, lead_days int")
    best = E.best_blend(E.blend_grid(frame, "base", "tree")).first()
    assert (best.tree_weight, best.drift_weight, best.mae) == (0.35, 0.0, 0.0)
    assert E.with_blend(frame, "base", "tree", 0.35, 0.0).first()[E.BLEND] == pytest.approx(35.0)
    with pytest.raises(ValueError):
        E.with_blend(frame, "base", "tree", 1.2, 0.0)


def test_pairing_rejects_rows_that_do_not_align(spark):
    good = [prediction("moving_average", 1.0, 2.0), prediction("seasonal_naive", 3.0, 2.0)]
    row = E.paired(spark.createDataFrame(good, PREDICTION), "moving_average", "seasonal_naive").first()
    assert (row.moving_average, row.seasonal_naive) == (1.0, 3.0)
    bad = spark.createDataFrame(good + [prediction("moving_average", 1.0, 2.0, day=3)], PREDICTION)
    with pytest.raises(Exception, match="do not cover the same rows"):
        E.paired(bad, "moving_average", "seasonal_naive").collect()


@pytest.mark.parametrize("values, chosen", [((9.0, 10.0), "seasonal_naive"), ((9.95, 10.0), "moving_average")])
def test_selection_needs_both_gates(spark, values, chosen):
    rows = []
    for fold in range(3):
        for day in range(4):
            rows.append(prediction("seasonal_naive", values[0], 0.0, day=day, fold=fold))
            rows.append(prediction("moving_average", values[1], 0.0, day=day, fold=fold))
    frame = spark.createDataFrame(rows, PREDICTION)
    choice = E.selected_method(E.method_comparison(frame), E.fold_wins(frame, "seasonal_naive", "moving_average"), "seasonal_naive", MODEL, ("moving_average",)).first()
    assert choice.selected_method == chosen and choice.fold_wins == 3


def test_intervals_are_asymmetric(spark):
    rows = [prediction("m", 100.0, 112.0, day=i) for i in range(100)] + [prediction("m", 100.0, 94.0, day=100 + i) for i in range(20)]
    frame = spark.createDataFrame(rows, PREDICTION)
    table = I.interval_quantiles(frame, 0.8, MODEL.interval_minimum_samples)
    scored = I.scored_intervals(I.with_interval(frame, table)).first()
    assert scored.interval_level == "market" and scored.calibration_n == 120
    assert (scored.lower, scored.upper) == (94.0, 112.0) and scored.covered
    assert {r.level for r in table.collect()} == set(I.LEVELS)


def test_bounds_hold_the_point_and_fall_back_to_the_global_level(spark):
    frame = spark.createDataFrame([prediction("m", 100.0, 100.0)], PREDICTION)
    table = spark.createDataFrame([("__global__", "__global__", 5, -20.0, -10.0)], "level string, interval_key string, n long, lower_residual double, upper_residual double")
    row = I.with_interval(frame, table).first()
    assert (row.lower, row.upper, row.interval_level, row.calibration_n) == (80.0, 100.0, "__global__", 5)
    low = I.with_interval(frame.withColumn("prediction", F.lit(0.5)), table).first()
    assert low.lower == 0.5 and low.upper >= low.lower


def test_thin_groups_are_left_out(spark):
    frame = spark.createDataFrame([prediction("m", 100.0, 101.0, day=i) for i in range(37)], PREDICTION)
    levels = {r.level for r in I.interval_quantiles(frame, 0.8, MODEL.interval_minimum_samples).collect()}
    assert levels == {"state_crop", "__global__"}


def test_quantiles_match_numpy_with_ties_skew_and_negative_values(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.concatenate([np.zeros(900), rng.normal(0, 1e4, 600)]), "one": np.array([7.25]), "two": np.array([-3.0, 5.0]), "wide": rng.lognormal(3, 4, 333) - 50}
    frame = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    wanted = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    rows = {r.g: r for r in exact_quantiles(frame, ["g"], "v", wanted).collect()}
    for name, values in groups.items():
        assert rows[name].n == len(values)
        for column, p in wanted.items():
            assert rows[name][column] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_rolled_quantiles_equal_those_of_each_level(spark):
    rng = np.random.default_rng(5)
    rows = [(f"m{i % 7}", "ab"[i % 2], int(i % 3), None if i % 11 == 0 else "v", 0.0 if i % 3 else float(rng.normal(0, 500))) for i in range(3000)]
    frame = spark.createDataFrame([*rows, ("m0", "a", 0, "v", None)], "market string, crop string, lead int, bucket string, v double").repartition(5)
    levels = {"market": ("market", "lead", "bucket"), "crop": ("crop", "lead", "bucket"), "lead": ("lead",), "all": ()}
    key = lambda level: F.concat_ws("|", F.lit(level), *(F.col(c).cast("string") for c in levels[level]))
    wanted = {"low": 0.1, "mid": 0.5, "high": 0.9}
    found = rolled_quantiles(frame, levels, "v", wanted, key)
    each = [exact_quantiles(frame.withColumn("level", F.lit(x)).withColumn("interval_key", key(x)), ["level", "interval_key"], "v", wanted) for x in levels]
    expected = {(r.level, r.interval_key): r for part in each for r in part.collect()}
    rows = {(r.level, r.interval_key): r for r in found.collect()}
    assert rows == expected and len(rows) > 40
    assert rolled_quantiles(frame.limit(0), levels, "v", wanted, key).count() == 0


def test_folds_and_summary_agree(series):
    frame = series(range(10, 400)).withColumn("coverage_tier", F.lit("high"))
    last = X.latest_target_date(frame, MODEL)
    rows = E.with_folds(X.training_rows(frame, MODEL), last, MODEL)
    counted = {(r.phase, r.fold_index): r["count"] for r in rows.groupBy("phase", "fold_index").count().collect()}
    for row in E.fold_summary(X.training_rows(frame, MODEL), last, MODEL).collect():
        phase = E.HOLDOUT if row.fold_index < 0 else E.SELECTION
        assert row.test_rows == counted[(phase, row.fold_index)] and row.usable
    bounds = rows.filter("fold_index >= 0").groupBy("fold_index").agg(F.countDistinct("target_date").alias("n")).collect()
    assert {r.fold_index: r.n for r in bounds} == {0: 60, 1: 60, 2: 60}


def test_bootstrap_is_repeatable_and_brackets_the_observed_value(spark):
    rows = [(date(2026, 1, 1) + timedelta(days=i), float(5 + i % 7 - 3), 4) for i in range(60)]
    by_date = spark.createDataFrame(rows, "target_date date, gain double, rows long")
    first = E.bootstrap(by_date, 500, 42).first()
    assert first == E.bootstrap(by_date.repartition(3), 500, 42).first()
    observed = E.observed_improvement(by_date).first()
    assert first.repetitions == 500 and observed.target_dates == 60
    assert first.ci_low <= observed.observed_mae_reduction <= first.ci_high and first.probability_improves == 1.0


def test_unknown_labels_and_bad_numbers_are_encoded(spark):
    known = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("a", 9.0), (None, None)], "c string, x double")
    rows = spark.createDataFrame([("a", 5.0), ("zz", None), ("b", float("nan")), ("b", float("inf"))], "c string, x double")
    done = M.encoded(rows, M.category_codes(known, ["c"]), M.numeric_medians(known, ["x"]), ["c"], ["x"])
    assert sorted((r.c_code, r.x) for r in done.collect()) == [(-1, 2.0), (0, 5.0), (1, 2.0), (1, 2.0)]


def test_tree_model_learns_and_ranks_features(series, spark, tmp_path):
    frame = M.with_levels(series([100 + (i % 7) * 10 for i in range(300)]).withColumn("coverage_tier", F.lit("high")))
    rows = E.with_folds(X.training_rows(frame, MODEL), X.latest_target_date(frame, MODEL), MODEL).persist()
    fitted = M.fit_tree(rows.filter("_before > 0"), replace(MODEL, trees=5), 1)
    done = M.predict_tree(fitted, rows.filter("_before <= 0"))
    assert done.count() == rows.filter("_before <= 0").count()
    assert done.filter(F.col(E.TREE) < 1).isEmpty()
    error = lambda guess: done.agg(F.avg(F.abs(F.col("target") - guess))).first()[0]
    assert error(F.col(E.TREE)) < error(F.lit(rows.filter("_before > 0").agg(F.median("target")).first()[0]))
    ranked = M.permutation_importance(fitted, rows.filter("_before <= 0"), MODEL, repeats=1).collect()
    assert len(ranked) == 30 and ranked[0].importance >= ranked[-1].importance
    M.save_model(fitted, spark.range(1), str(tmp_path))
    loaded, parameters = M.load_model(spark, str(tmp_path))
    assert sorted(map(tuple, M.predict_tree(loaded, rows.filter("_before <= 0")).collect())) == sorted(map(tuple, done.collect()))
    assert parameters.count() == 1
    rows.unpersist()


def test_training_selects_stores_and_forecasts(series, spark, tmp_path):
    from bazaarflow.operators import coverage as C
    from bazaarflow.plans import training
    from bazaarflow.settings import DEFAULTS, Settings

    quality = replace(DEFAULTS.quality, maximum_age_days=30)
    model = replace(MODEL, trees=3, minimum_training_rows=200)
    days = series([100 + (i % 7) * 10 for i in range(330)]).unionByName(series([200 + i % 11 for i in range(330)], market="20-2"))
    coverage = C.series_coverage(days, quality)
    trained = training.train_and_select(days, coverage, Settings(quality, model), str(tmp_path))
    methods = {r.method for r in trained.predictions.select("method").distinct().collect()}
    assert methods == {*X.BASELINES, E.TREE, E.BLEND} and trained.choice["selected_method"] in methods
    table = training.forecasts(spark, str(tmp_path), days, coverage, Settings(quality, model)).collect()
    assert len(table) == 14 and {r.method for r in table} == {trained.choice["selected_method"]}
    assert all(r.forecast_low <= r.forecast_price <= r.forecast_high for r in table)


def test_levels_only_look_back(series):
    frame = M.with_levels(series([10, 20, 60]).unionByName(series([100, 100, 100], market="20-2")))
    rows = {(r.market_id, r.date.day): (r.market_id_level, r.commodity_level) for r in frame.collect()}
    assert rows["20-1", 1] == (10.0, 55.0) and rows["20-1", 2] == (15.0, 57.5) and rows["20-1", 3] == (30.0, 65.0)
