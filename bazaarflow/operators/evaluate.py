"""Chronological folds, metrics, method ranking, blending and model selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.operators.features import BASELINES
from bazaarflow.settings import ModelSettings

# Method names in ranking order of equals, and the blend grid.
TREE = "hist_gradient_boosting"
BLEND = "recent_level_tree_blend"
METHODS = (*BASELINES, TREE, BLEND)
METHOD_LABELS = {
    "last_observation": "Last observation",
    "moving_average": "Five-report moving average",
    "seasonal_naive": "Seven-day seasonal naive",
    TREE: "Global histogram gradient boosting",
    BLEND: "Validated recent-level + lead-aware blend",
}
TREE_WEIGHTS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)
DRIFT_WEIGHTS = (0.0, 0.025, 0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2)

HOLDOUT, SELECTION, EARLIER = "locked_holdout", "model_selection", "earlier"
PAIR_KEY = ("phase", "fold_index", "state", "commodity", "market_id", "lead_days", "target_date")


# --- folds -----------------------------------------------------------------

def with_folds(rows: DataFrame, last_target: Column, model: ModelSettings) -> DataFrame:
    """Phase and fold of each row by arithmetic on its target date, no range join.

    Days before the holdout fall into windows of `fold_days`; the newest window is the last fold.
    """
    before = F.datediff(F.date_sub(last_target, model.holdout_days - 1), "target_date")
    window = F.ceil(F.col("_before") / model.fold_days)
    holdout, tested = F.col("_before") <= 0, window <= model.folds
    return rows.withColumn("_before", before).withColumns({
        "phase": F.when(holdout, HOLDOUT).when(tested, SELECTION).otherwise(EARLIER),
        "fold_index": F.when(holdout, -1).when(tested, model.folds - window).cast("long"),
    })


def tested_since(last_target: Column, model: ModelSettings) -> Column:
    """First target date of the selection folds."""
    return F.date_sub(last_target, model.holdout_days - 1 + model.folds * model.fold_days)


def fold_summary(rows: DataFrame, last_target: Column, model: ModelSettings) -> DataFrame:
    """Training and test row counts per fold from one pass over the target dates.

    `rows` are training rows or, with a column `targets`, dates that stand for that many of them.
    """
    before = F.col("_before")
    weight = F.col("targets") if "targets" in rows.columns else F.lit(1)
    date = F.col("date") if "targets" in rows.columns else F.col("target_date")
    counted = lambda chosen: F.coalesce(F.sum(F.when(chosen, F.col("_weight"))), F.lit(0)).cast("long")
    counts = []
    for fold in range(model.folds):
        test_oldest = (model.folds - fold) * model.fold_days
        counts += [
            counted(before > test_oldest).alias(f"train_{fold}"),
            counted((before <= test_oldest) & (before > test_oldest - model.fold_days)).alias(f"test_{fold}"),
        ]
    start = F.date_sub(last_target, model.holdout_days - 1)
    one = rows.select(F.datediff(start, date).alias("_before"), weight.alias("_weight")).agg(
        *counts, counted(before > 0).alias("train_-1"), counted(before <= 0).alias("test_-1")
    )
    folds = [
        F.struct(
            F.lit(fold).cast("long").alias("fold_index"),
            F.date_sub(start, (model.folds - fold) * model.fold_days).alias("test_start"),
            F.date_sub(start, (model.folds - fold - 1) * model.fold_days).alias("test_end"),
            F.col(f"train_{fold}").alias("training_rows"),
            F.col(f"test_{fold}").alias("test_rows"),
        )
        for fold in range(model.folds)
    ] + [
        F.struct(
            F.lit(-1).cast("long").alias("fold_index"), start.alias("test_start"),
            F.date_add(last_target, 1).alias("test_end"),
            F.col("train_-1").alias("training_rows"), F.col("test_-1").alias("test_rows"),
        )
    ]
    return one.select(F.inline(F.array(*folds))).withColumn(
        "usable",
        (F.col("training_rows") >= model.minimum_training_rows) & (F.col("test_rows") > 0),
    )


def usable_folds(summary: DataFrame, minimum_folds: int = 2) -> Column:
    """Index of every usable fold, as a scalar array. Too few folds, or no holdout, stop the job."""
    found = summary.filter("usable").agg(F.collect_set("fold_index").alias("folds"))
    selection = F.size(F.filter("folds", lambda f: f >= 0))
    checked = (
        F.when(selection < minimum_folds, F.raise_error(F.lit("fewer usable selection folds than required")).cast("array<bigint>"))
        .when(~F.array_contains("folds", F.lit(-1).cast("long")), F.raise_error(F.lit("the holdout has no usable rows")).cast("array<bigint>"))
        .otherwise(F.col("folds"))
    )
    return found.select(checked).scalar()


# --- predictions -----------------------------------------------------------

def wide_predictions(folded: DataFrame, *more: str) -> DataFrame:
    """Test rows only, with the three baselines, and any other prediction, as columns."""
    return folded.filter(F.col("phase") != EARLIER).select(
        "phase", "fold_index", "state", "commodity", "market", "market_id", "coverage_tier",
        "volatility_bucket", "lead_days", "target_date", F.col("target").alias("actual"),
        "current_price", "rolling_mean_7d",
        *(F.col(column).alias(method) for method, column in BASELINES.items()), *more,
    )


def long_predictions(wide: DataFrame, methods=tuple(BASELINES)) -> DataFrame:
    """One row per method. The rows are repeated in place, without a join or union."""
    kept = [c for c in wide.columns if c not in methods]
    pairs = F.array(*(
        F.struct(F.lit(m).alias("method"), F.col(m).alias("prediction")) for m in methods
    ))
    return wide.select(*kept, F.inline(pairs))


def paired(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """Two methods side by side; an unmatched row stops the job."""
    kept = [c for c in ("actual", "current_price", "rolling_mean_7d") if c in predictions.columns]
    of = lambda method: F.max(F.when(F.col("method") == method, F.col("prediction")))
    both = (
        predictions.filter(F.col("method").isin(first, second))
        .groupBy(*PAIR_KEY)
        .agg(*(F.max(c).alias(c) for c in kept), of(first).alias(first), of(second).alias(second))
    )
    missing = F.col(first).isNull() | F.col(second).isNull()
    failure = F.raise_error(F.lit(f"{first} and {second} do not cover the same rows")).cast("double")
    return both.withColumn(first, F.when(missing, failure).otherwise(F.col(first)))


# --- metrics ---------------------------------------------------------------

def metric_columns(prediction: str = "prediction") -> list[Column]:
    """Count, MAE, WAPE, sMAPE and directional accuracy; sums only, so they combine early."""
    actual, predicted, current = F.col("actual"), F.col(prediction), F.col("current_price")
    error = F.abs(actual - predicted)
    size = F.abs(actual) + F.abs(predicted)
    agrees = F.signum(predicted - current) == F.signum(actual - current)
    return [
        F.count("*").alias("n"),
        rounded(F.avg(error), 2).alias("mae"),
        rounded(F.sum(error) / F.greatest(F.sum(F.abs(actual)), F.lit(1.0)), 4).alias("wape"),
        rounded(F.avg(2 * error / F.greatest(size, F.lit(1.0))), 4).alias("smape"),
        rounded(F.avg(agrees.cast("double")), 4).alias("directional_accuracy"),
    ]


def method_order() -> Column:
    return F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))


def method_comparison(predictions: DataFrame) -> DataFrame:
    labels = F.create_map(*(F.lit(x) for pair in METHOD_LABELS.items() for x in pair))
    return (
        predictions.groupBy("method").agg(*metric_columns())
        .withColumn("label", labels[F.col("method")])
        .orderBy("mae", method_order())
    )


def segment_metrics(predictions: DataFrame, fields=("lead_days", "commodity", "state", "market", "coverage_tier")) -> DataFrame:
    pairs = F.array(*(
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("segment")) for f in fields
    ))
    return (
        predictions.select("method", "actual", "prediction", "current_price", F.inline(pairs))
        .groupBy("method", "field", "segment")
        .agg(*metric_columns())
    )


def fold_wins(predictions: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Folds in which the candidate has the strictly lower rounded MAE."""
    per_fold = predictions.filter(F.col("method").isin(candidate, baseline)).groupBy(
        "fold_index", "method"
    ).agg(rounded(F.avg(F.abs(F.col("actual") - F.col("prediction"))), 2).alias("mae"))
    of = lambda method: F.max(F.when(F.col("method") == method, F.col("mae")))
    sides = per_fold.groupBy("fold_index").agg(of(candidate).alias("c"), of(baseline).alias("b"))
    return sides.agg(
        F.count_if(F.col("c") < F.col("b")).alias("fold_wins"),
        F.count("*").alias("usable_folds"),
        rounded(F.count_if(F.col("c") < F.col("b")) / F.count("*"), 4).alias("fold_win_share"),
    )


# --- blending --------------------------------------------------------------

def blended(baseline: Column, tree: Column, tree_weight: Column | float, drift_weight: Column | float) -> Column:
    for name, weight in (("tree", tree_weight), ("drift", drift_weight)):
        if not isinstance(weight, Column) and not 0.0 <= weight <= 1.0:
            raise ValueError(f"{name} weight must lie between zero and one")
    w = tree_weight if isinstance(tree_weight, Column) else F.lit(float(tree_weight))
    d = drift_weight if isinstance(drift_weight, Column) else F.lit(float(drift_weight))
    drift = d * (F.col("current_price") - F.col("rolling_mean_7d")) / 7.0 * F.col("lead_days")
    return F.greatest(baseline * (1.0 - w) + tree * w + drift, F.lit(1.0))


def blend_grid(wide: DataFrame, baseline: str, tree: str, tree_weights=TREE_WEIGHTS,
               drift_weights=DRIFT_WEIGHTS) -> DataFrame:
    """Mean absolute error of every weight pair in one pass.

    The fixed list of pairs is unfolded inside the scan stage and summed up there, so one row per
    pair and task is shuffled, whatever the number of rows.
    """
    pairs = F.array(*(
        F.struct(F.lit(t).alias("tree_weight"), F.lit(d).alias("drift_weight"))
        for t in tree_weights for d in drift_weights
    ))
    tried = wide.select(
        "actual", baseline, tree, "current_price", "rolling_mean_7d", "lead_days", F.inline(pairs)
    )
    point = blended(F.col(baseline), F.col(tree), F.col("tree_weight"), F.col("drift_weight"))
    return tried.groupBy("tree_weight", "drift_weight").agg(
        rounded(F.avg(F.abs(F.col("actual") - point)), 6).alias("mae")
    )


def best_blend(grid: DataFrame) -> DataFrame:
    """Lowest error; among equals the smaller drift, then the smaller tree weight."""
    return grid.agg(F.min(F.struct("mae", "drift_weight", "tree_weight")).alias("best")).select("best.*")


def with_blend(wide: DataFrame, baseline: str, tree: str, tree_weight: float, drift_weight: float,
               name: str = BLEND) -> DataFrame:
    return wide.withColumn(name, blended(F.col(baseline), F.col(tree), tree_weight, drift_weight))


# --- selection -------------------------------------------------------------

def selected_method(comparison: DataFrame, wins: DataFrame, candidate: str, model: ModelSettings,
                    baselines=tuple(BASELINES)) -> DataFrame:
    """The candidate when it clears both gates, else the strongest baseline."""
    ranked = comparison.withColumn("_order", method_order())
    best = ranked.filter(F.col("method").isin(list(baselines))).agg(
        F.min(F.struct("mae", "_order", "method")).alias("b")
    )
    mine = ranked.filter(F.col("method") == candidate).agg(F.max("mae").alias("candidate_mae"))
    improvement = 1.0 - F.col("candidate_mae") / F.col("b.mae")
    share = F.col("fold_wins") / F.col("usable_folds")
    passes = (improvement >= model.minimum_improvement) & (share >= model.minimum_fold_win_share)
    # one row each: read as scalars
    return best.select(
        F.col("b"), mine.scalar().alias("candidate_mae"),
        wins.select("fold_wins").scalar().alias("fold_wins"),
        wins.select("usable_folds").scalar().alias("usable_folds"),
    ).select(
        F.lit(candidate).alias("candidate_method"),
        F.col("b.method").alias("strongest_baseline"),
        rounded(improvement, 4).alias("candidate_improvement"),
        "fold_wins", "usable_folds",
        F.when(passes, candidate).otherwise(F.col("b.method")).alias("selected_method"),
    )


# --- bootstrap -------------------------------------------------------------

def improvement_by_date(pairs: DataFrame, candidate: str, baseline: str) -> DataFrame:
    gain = F.abs(F.col("actual") - F.col(baseline)) - F.abs(F.col("actual") - F.col(candidate))
    return pairs.groupBy("target_date").agg(F.sum(gain).alias("gain"), F.count("*").alias("rows"))


def observed_improvement(by_date: DataFrame) -> DataFrame:
    return by_date.agg(
        F.count("*").alias("target_dates"),
        rounded(F.sum("gain") / F.sum("rows"), 2).alias("observed_mae_reduction"),
    )


def bootstrap(by_date: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """Resample target dates with replacement. Dates are per-day sums, at most one row per day.

    Each draw picks a date by the leading hex digits of an md5 of seed, repetition and draw, which any
    engine can repeat, so retries draw the same dates.
    """
    # one row per holdout day, so this unpartitioned window is bounded by the holdout length
    slot = F.row_number().over(Window.orderBy("target_date")) - 1
    numbered = by_date.withColumn("slot", slot.cast("long"))
    dates = by_date.select(F.count("*")).scalar()
    draws = (
        by_date.sparkSession.range(repetitions).withColumnRenamed("id", "repetition")
        .withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), dates)))
        .withColumn("slot", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "repetition", "draw")), 1, 12), 16, 10).cast("long") % dates)
    )
    means = draws.join(numbered, "slot").groupBy("repetition").agg(
        (F.sum("gain") / F.sum("rows")).alias("mean_gain")
    )
    return means.agg(
        F.count("*").alias("repetitions"),
        F.percentile("mean_gain", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"),
        F.avg((F.col("mean_gain") > 0).cast("double")).alias("p"),
    ).select(
        "repetitions",
        rounded(F.col("ci")[0], 2).alias("ci_low"),
        rounded(F.col("ci")[1], 2).alias("ci_high"),
        rounded(F.col("p"), 4).alias("probability_improves"),
    )

