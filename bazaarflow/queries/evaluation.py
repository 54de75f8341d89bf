"""Registered queries: folds, metrics, blending, selection, intervals, bootstrap and the tree model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.operators import evaluate as E
from bazaarflow.operators import intervals as I
from bazaarflow.operators.features import latest_target_date, targets_per_report, training_rows
from bazaarflow.queries.base import (
    METRICS_SQL, MODEL, folded, long, oracle, register, rnd, stored_history, stored_wide, tested_rows, tiered, wide,
)
from bazaarflow.session import write_and_reload

# The blend and the gates are checked on two baselines, which both engines compute exactly.
BASE, CANDIDATE = "moving_average", "seasonal_naive"
PAIR = ["phase", "fold_index", "state", "commodity", "market_id", "lead_days", "target_date"]


def selection(frame):
    return frame.filter(F.col("phase") == E.SELECTION)


@register("fold_assignment", oracle(f"""
  with last as (select max(target_date) as t from training),
  folds as (select f as fold_index, t - {MODEL.holdout_days - 1} - (3 - f) * {MODEL.fold_days} as test_start,
      t - {MODEL.holdout_days - 1} - (2 - f) * {MODEL.fold_days} as test_end from last, (select cast(unnest([0, 1, 2]) as integer) as f)
    union all select -1, t - {MODEL.holdout_days - 1}, t + 1 from last)
  select fold_index, test_start, test_end, count(*) filter (where target_date < test_start) as training_rows,
    count(*) filter (where target_date >= test_start and target_date < test_end) as test_rows,
    count(*) filter (where target_date < test_start) >= {MODEL.minimum_training_rows}
      and count(*) filter (where target_date >= test_start and target_date < test_end) > 0 as usable
  from training, folds group by 1, 2, 3""", "training"))
def fold_assignment(spark, sf):
    days = stored_history(spark, sf).withColumn("coverage_tier", F.lit(None).cast("string"))
    return E.fold_summary(training_rows(days, MODEL), latest_target_date(days, MODEL), MODEL)


_THIN_SQL = f"""
  with last as (select max(target_date) as t from training),
  thin as (select count(*) + 1 as least_rows from training, last where target_date < t - {MODEL.holdout_days - 1} - {MODEL.folds * MODEL.fold_days}),
  counts as (select f, count(*) filter (where before > ({MODEL.folds} - f) * {MODEL.fold_days}) as n from folded, (select unnest([0, 1, 2]) as f) group by 1)
  select fold_index, method, count(*) as n, {rnd('avg(abs(actual - prediction))', 2)} as mae
  from predictions where phase = 'locked_holdout' or fold_index in (select f from counts, thin where n >= least_rows)
  group by 1, 2"""


@register("fold_usability", oracle(_THIN_SQL, "predictions"))
def fold_usability(spark, sf):
    """Errors by fold when the oldest fold has one training row less than required: it is left out."""
    days = write_and_reload(tiered(spark, sf), "tiered")
    counts = E.fold_summary(targets_per_report(days, MODEL), latest_target_date(days, MODEL), MODEL)
    oldest = counts.filter("fold_index = 0").first()["training_rows"]
    rows = E.long_predictions(tested_rows(days, replace(MODEL, minimum_training_rows=oldest + 1)))
    return rows.groupBy("fold_index", "method").agg(
        F.count("*").alias("n"), rounded(F.avg(F.abs(F.col("actual") - F.col("prediction"))), 2).alias("mae")
    )


@register("union_methods", oracle(f"""
  select phase, fold_index, commodity, market_id, lead_days, target_date, actual, method, {rnd('prediction', 4)} as prediction
  from predictions""", "predictions"))
def union_methods(spark, sf):
    return long(spark, sf).select(
        "phase", "fold_index", "commodity", "market_id", "lead_days", "target_date", "actual", "method",
        rounded(F.col("prediction"), 4).alias("prediction"),
    )


@register("metrics_by_method", oracle(f"""
  select method, case method when 'last_observation' then 'Last observation' when 'moving_average' then 'Five-report moving average'
    else 'Seven-day seasonal naive' end as label, {METRICS_SQL}
  from predictions where phase = 'model_selection' group by method""", "predictions"))
def metrics_by_method(spark, sf):
    return E.method_comparison(selection(long(spark, sf)))


_SEGMENTS = ("lead_days", "commodity", "state", "market", "coverage_tier")


@register("metrics_by_segment", oracle("\nunion all\n".join(
    f"select method, '{s}' as field, cast({s} as varchar) as segment, {METRICS_SQL} from predictions where phase = 'locked_holdout' group by method, {s}"
    for s in _SEGMENTS), "predictions"))
def metrics_by_segment(spark, sf):
    return E.segment_metrics(long(spark, sf).filter(F.col("phase") == E.HOLDOUT), _SEGMENTS)


_WINS_SQL = f"""
  sides as (select fold_index, {rnd(f'avg(abs(actual - {CANDIDATE}))', 2)} as c, {rnd(f'avg(abs(actual - {BASE}))', 2)} as b
    from wide where phase = 'model_selection' group by 1),
  wins as (select count(*) filter (where c < b) as fold_wins, count(*) as usable_folds,
    {rnd('count(*) filter (where c < b) / count(*)', 4)} as fold_win_share from sides)"""


@register("fold_wins", oracle(f"with {_WINS_SQL} select * from wins", "wide"))
def fold_wins(spark, sf):
    return E.fold_wins(selection(long(spark, sf)), CANDIDATE, BASE)


@register("pair_methods", oracle(f"""
  select {', '.join(PAIR)}, actual, current_price, {rnd('rolling_mean_7d', 4)} as rolling_mean_7d,
    {rnd(BASE, 4)} as {BASE}, {rnd(CANDIDATE, 4)} as {CANDIDATE} from wide""", "wide"))
def pair_methods(spark, sf):
    return E.paired(long(spark, sf), BASE, CANDIDATE).select(
        *PAIR, "actual", "current_price", *(rounded(F.col(c), 4).alias(c) for c in ("rolling_mean_7d", BASE, CANDIDATE))
    )


def _blend_sql(weight, drift):
    return (f"greatest({BASE} * (1 - {weight}) + {CANDIDATE} * {weight} + "
            f"{drift} * (current_price - rolling_mean_7d) / 7 * lead_days, 1)")


_GRID_SQL = f"""
  grid as (select t as tree_weight, d as drift_weight from (select unnest({list(E.TREE_WEIGHTS)}::double[]) as t), (select unnest({list(E.DRIFT_WEIGHTS)}::double[]) as d)),
  errors as (select tree_weight, drift_weight, {rnd(f"avg(abs(actual - {_blend_sql('tree_weight', 'drift_weight')}))", 6)} as mae
    from wide, grid where phase = 'model_selection' group by 1, 2)"""


@register("blend_predict", oracle(f"""
  select {', '.join(PAIR)}, {rnd(_blend_sql('cast(0.25 as double)', 'cast(0.075 as double)'), 4)} as prediction from wide""", "wide"))
def blend_predict(spark, sf):
    done = E.with_blend(wide(spark, sf), BASE, CANDIDATE, 0.25, 0.075)
    return done.select(*PAIR, rounded(F.col(E.BLEND), 4).alias("prediction"))


@register("blend_grid_search", oracle(f"with {_GRID_SQL} select * from errors", "wide"))
def blend_grid_search(spark, sf):
    return E.blend_grid(selection(wide(spark, sf)), BASE, CANDIDATE)


@register("argmin_blend", oracle(f"with {_GRID_SQL} select * from errors order by mae, drift_weight, tree_weight limit 1", "wide"))
def argmin_blend(spark, sf):
    return E.best_blend(blend_grid_search(spark, sf))


@register("select_method", oracle(f"""
  with {_WINS_SQL},
  maes as (select method, {rnd('avg(abs(actual - prediction))', 2)} as mae from predictions where phase = 'model_selection' group by 1),
  best as (select method, mae from maes order by mae, list_position(['last_observation', 'moving_average', 'seasonal_naive'], method) limit 1),
  own as (select mae from maes where method = '{CANDIDATE}')
  select '{CANDIDATE}' as candidate_method, best.method as strongest_baseline, {rnd('1 - own.mae / best.mae', 4)} as candidate_improvement,
    fold_wins, usable_folds, case when 1 - own.mae / best.mae >= {MODEL.minimum_improvement} and fold_wins / usable_folds >= {MODEL.minimum_fold_win_share}
      then '{CANDIDATE}' else best.method end as selected_method
  from best, own, wins""", "wide", "predictions"))
def select_method(spark, sf):
    rows = selection(E.long_predictions(stored_wide(spark, sf)))
    return E.selected_method(E.method_comparison(rows), E.fold_wins(rows, CANDIDATE, BASE), CANDIDATE, MODEL)


# --- intervals -------------------------------------------------------------

def calibration(tested, *phases):
    rows = tested.filter(F.col("phase").isin(*phases)).withColumn("prediction", F.col(BASE))
    return I.interval_quantiles(rows, MODEL.interval_coverage, MODEL.interval_minimum_samples)


def quantiles_sql(phases):
    keys = {
        "market": "'market|' || market_id || '|' || lead_days || '|' || volatility_bucket",
        "state_crop": "'state_crop|' || state || '|' || commodity || '|' || lead_days || '|' || volatility_bucket",
        "crop": "'crop|' || commodity || '|' || lead_days",
        "lead": "'lead|' || lead_days",
        "__global__": "'__global__'",
    }
    low, high = (1 - MODEL.interval_coverage) / 2, 1 - (1 - MODEL.interval_coverage) / 2
    parts = [
        f"""select '{level}' as level, {key} as interval_key, quantile_cont(actual - {BASE}, {low}) as lower_residual,
          quantile_cont(actual - {BASE}, {high}) as upper_residual, count(*) as n
        from wide where phase in ({phases}) group by 1, 2 having count(*) >= {MODEL.interval_minimum_samples.get(level, 0)}"""
        for level, key in keys.items()
    ]
    return "\nunion all\n".join(parts)


@register("interval_quantiles", oracle(f"""
  select level, interval_key, n, {rnd('lower_residual', 4)} as lower_residual, {rnd('upper_residual', 4)} as upper_residual
  from ({quantiles_sql("'model_selection'")})""", "wide"))
def interval_quantiles(spark, sf):
    return calibration(stored_wide(spark, sf), E.SELECTION).select(
        "level", "interval_key", "n", rounded(F.col("lower_residual"), 4).alias("lower_residual"),
        rounded(F.col("upper_residual"), 4).alias("upper_residual"),
    )


def fallback_sql(rows, prediction):
    joins = " ".join(
        f"left join quantiles q{i} on q{i}.interval_key = {key}" for i, key in enumerate((
            "'market|' || r.market_id || '|' || r.lead_days || '|' || r.volatility_bucket",
            "'state_crop|' || r.state || '|' || r.commodity || '|' || r.lead_days || '|' || r.volatility_bucket",
            "'crop|' || r.commodity || '|' || r.lead_days", "'lead|' || r.lead_days", "'__global__'"))
    )
    first = lambda c: "coalesce(" + ", ".join(f"q{i}.{c}" for i in range(5)) + ")"
    return f"""
      select *, greatest({prediction}, lower, {prediction} + upper_residual) as upper from (
        select *, least({prediction}, greatest(1, {prediction} + lower_residual)) as lower from (
          select r.*, {first('lower_residual')} as lower_residual, {first('upper_residual')} as upper_residual,
            {first('level')} as interval_level, {first('n')} as calibration_n
          from {rows} r {joins}))"""


_BOUNDED_SQL = f"""
  quantiles as ({quantiles_sql("'model_selection'")}),
  bounded as ({fallback_sql("(select * from wide where phase = 'locked_holdout')", BASE)}),
  scored_rows as (select *, upper - lower as interval_width, actual between lower and upper as covered from bounded)"""


def _bounded(spark, sf):
    tested = stored_wide(spark, sf)
    rows = tested.filter(F.col("phase") == E.HOLDOUT).withColumn("prediction", F.col(BASE))
    return I.with_interval(rows, write_and_reload(calibration(tested, E.SELECTION), "quantiles"))


_ROW = ("commodity", "market_id", "lead_days", "target_date")


@register("interval_fallback", oracle(f"""
  with {_BOUNDED_SQL} select {', '.join(_ROW)}, interval_level, calibration_n, {rnd('lower', 2)} as lower, {rnd('upper', 2)} as upper from bounded""", "wide"))
def interval_fallback(spark, sf):
    return _bounded(spark, sf).select(
        *_ROW, "interval_level", "calibration_n", rounded(F.col("lower"), 2).alias("lower"), rounded(F.col("upper"), 2).alias("upper")
    )


@register("interval_score", oracle(f"""
  with {_BOUNDED_SQL} select {', '.join(_ROW)}, {rnd('interval_width', 2)} as interval_width, covered from scored_rows""", "wide"))
def interval_score(spark, sf):
    return I.scored_intervals(_bounded(spark, sf)).select(*_ROW, rounded(F.col("interval_width"), 2).alias("interval_width"), "covered")


_SUMMARY = f"count(*) as n, {rnd('avg(case when covered then 1.0 else 0.0 end)', 4)} as empirical_coverage, {rnd('avg(interval_width)', 2)} as mean_width"


@register("interval_coverage", oracle(f"with {_BOUNDED_SQL} select 'overall' as field, 'all' as segment, {_SUMMARY} from scored_rows union all "
    + " union all ".join(f"select '{f}', cast({f} as varchar), {_SUMMARY} from scored_rows group by {f}" for f in ("state", "commodity", "lead_days", "market")), "wide"))
def interval_coverage(spark, sf):
    return I.interval_coverage(I.scored_intervals(_bounded(spark, sf)))


# --- bootstrap -------------------------------------------------------------

def _by_date(spark, sf):
    rows = wide(spark, sf).filter(F.col("phase") == E.HOLDOUT)
    return E.improvement_by_date(rows, CANDIDATE, BASE)


@register("bootstrap_observed", oracle(f"""
  select count(distinct target_date) as target_dates, {rnd(f'avg(abs(actual - {BASE}) - abs(actual - {CANDIDATE}))', 2)} as observed_mae_reduction
  from wide where phase = 'locked_holdout'""", "wide"))
def bootstrap_observed(spark, sf):
    return E.observed_improvement(_by_date(spark, sf))


@register("bootstrap_ci", oracle(f"""
  with by_date as (select target_date, sum(abs(actual - {BASE}) - abs(actual - {CANDIDATE})) as gain, count(*) as n_rows
    from wide where phase = 'locked_holdout' group by 1),
  numbered as (select *, row_number() over (order by target_date) - 1 as slot, count(*) over () as dates from by_date),
  draws as (select r as repetition, ('0x' || substr(md5('{MODEL.seed}|' || r || '|' || d), 1, 12))::bigint % dates as slot
    from (select unnest(range({MODEL.bootstrap_repetitions})) as r), (select dates, unnest(range(1, dates + 1)) as d from (select max(dates) as dates from numbered))),
  means as (select repetition, sum(gain) / sum(n_rows) as gain from draws join numbered using (slot) group by 1)
  select count(*) as repetitions, {rnd('quantile_cont(gain, 0.025)', 2)} as ci_low, {rnd('quantile_cont(gain, 0.975)', 2)} as ci_high,
    {rnd('avg(case when gain > 0 then 1.0 else 0.0 end)', 4)} as probability_improves from means""", "wide"))
def bootstrap_ci(spark, sf):
    return E.bootstrap(write_and_reload(_by_date(spark, sf), "dates"), MODEL.bootstrap_repetitions, MODEL.seed)
