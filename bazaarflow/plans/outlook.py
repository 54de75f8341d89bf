"""Published history to forecasts, and forecasts to the published catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarflow.operators import evaluate as E
from bazaarflow.operators import forecast as P
from bazaarflow.operators import intervals as I
from bazaarflow.operators.features import (
    BASELINES, forecast_rows, latest_target_date, targets_per_report, training_rows, with_tier,
)
from bazaarflow.session import write_and_reload
from bazaarflow.settings import ModelSettings, Settings


def tested_rows(days: DataFrame, model: ModelSettings) -> DataFrame:
    """Baselines on the usable folds and the holdout; earlier targets are never built."""
    last = latest_target_date(days, model)
    usable = E.usable_folds(E.fold_summary(targets_per_report(days, model), last, model))
    rows = E.with_folds(training_rows(days, model, E.tested_since(last, model)), last, model)
    tested = E.wide_predictions(rows).withColumn("_usable", usable)
    return tested.filter(F.array_contains("_usable", F.col("fold_index"))).drop("_usable")


def baseline_forecasts(history: DataFrame, coverage: DataFrame, method: str, settings: Settings) -> DataFrame:
    """Forecast table of one baseline with intervals from its fold and holdout residuals."""
    model = settings.model
    days = write_and_reload(with_tier(history, coverage), "tiered")
    tested = tested_rows(days, model).withColumn("prediction", F.col(method))
    quantiles = I.interval_quantiles(
        write_and_reload(tested, "predictions"), model.interval_coverage, model.interval_minimum_samples
    )
    rows = forecast_rows(days, model).withColumn(
        "prediction", P.point(method, settings.quality.maximum_price)
    )
    return P.forecast_table(I.with_interval(rows, write_and_reload(quantiles, "quantiles")), method)


def strongest_baseline(history: DataFrame, coverage: DataFrame, settings: Settings) -> str:
    """Name of the baseline with the lowest pooled error on the selection folds."""
    model = settings.model
    days = write_and_reload(with_tier(history, coverage), "tiered")
    tested = E.long_predictions(tested_rows(days, model).filter(F.col("phase") == E.SELECTION))
    return E.method_comparison(tested).filter(F.col("method").isin(list(BASELINES))).first()["method"]
