"""Registered queries: feature rows, targets, forecast rows and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.operators import features as X
from bazaarflow.operators import model as M
from bazaarflow.session import write_and_reload
from bazaarflow.queries.base import MODEL, history, oracle, register, rnd, tiered, training

# computed doubles are rounded before rows are compared
MEASURED = (
    "rolling_mean_7d", "rolling_mean_14d", "rolling_mean_30d", "rolling_mean_90d", "rolling_median_30d",
    "rolling_std_30d", "relative_volatility_30d", "momentum_7d", "current_spread", "baseline_moving_average",
)
PLAIN = (
    "origin_date", "state", "commodity", "market_id", "market", "district", "coverage_tier", "volatility_bucket",
    "arrival_coverage", "current_price", "current_min_price", "current_max_price", "current_arrivals",
    "current_arrivals_missing", "lag_1d", "lag_7d", "lag_14d", "lag_28d", "reporting_gap_days", "reports_30d",
    "baseline_last", "baseline_seasonal_naive",
)
TARGET = ("target_date", "lead_days", "target_offset_days", "data_age_days", "target_weekday", "target_week", "target_month")


def _shown(frame, *more):
    return frame.select(*PLAIN, *more, *(rounded(F.col(c), 4).alias(c) for c in MEASURED))


def _shown_sql(*more):
    return ", ".join([*PLAIN, *more, *(f"{rnd(c, 4)} as {c}" for c in MEASURED)])


@register("features_origin", oracle(f"select {_shown_sql()} from featured where report_number >= 9", "featured"))
def features_origin(spark, sf):
    return _shown(X.origins(tiered(spark, sf), MODEL))


@register("baselines", oracle(f"""
  select commodity, market_id, origin_date, baseline_last, {rnd('baseline_moving_average', 4)} as baseline_moving_average,
    baseline_seasonal_naive from featured where report_number >= 9""", "featured"))
def baselines(spark, sf):
    return X.origins(tiered(spark, sf), MODEL).select(
        "commodity", "market_id", "origin_date", "baseline_last",
        rounded(F.col("baseline_moving_average"), 4).alias("baseline_moving_average"), "baseline_seasonal_naive",
    )


@register("join_future_targets", oracle("""
  select o.commodity, o.market_id, o.date as origin_date, t.date as target_date, t.representative_price as target,
    date_diff('day', o.date, t.date) as lead_days
  from history o join history t on o.commodity = t.commodity and o.market_id = t.market_id
    and t.date > o.date and t.date <= o.date + 28""", "history"))
def join_future_targets(spark, sf):
    from bazaarflow.operators.series import following

    ahead = history(spark, sf).select("commodity", "market_id", F.col("date").alias("origin_date"), following(28).alias("t"))
    return ahead.select("commodity", "market_id", "origin_date", F.explode("t").alias("t")).select(
        "commodity", "market_id", "origin_date", F.col("t.date").alias("target_date"), F.col("t.price").alias("target"),
        F.datediff("t.date", "origin_date").cast("long").alias("lead_days"),
    )


@register("training_rows", oracle(f"select {_shown_sql('target', *TARGET)} from training", "training"))
def training_rows(spark, sf):
    return _shown(training(spark, sf), "target", *TARGET)


FORECAST_SQL = f"""
  select *, comparison_date + target_offset_days as target_date, data_age_days + target_offset_days as lead_days,
    isodow(comparison_date + target_offset_days) - 1 as target_weekday, weekofyear(comparison_date + target_offset_days) as target_week,
    month(comparison_date + target_offset_days) as target_month
  from (select *, date_diff('day', origin_date, comparison_date) as data_age_days, cast(unnest(range(1, 8)) as integer) as target_offset_days
    from (select *, (select max(date) from {{history}}) as comparison_date from {{featured}})
    where report_number = series_size and series_size >= {MODEL.minimum_reports})
  where data_age_days + {MODEL.horizon_days} <= {MODEL.maximum_lead_days}"""


@register("forecast_rows", oracle(
    f"select {_shown_sql('comparison_date', *TARGET)} from ({FORECAST_SQL.format(history='history', featured='featured')})", "featured"))
def forecast_rows(spark, sf):
    return _shown(X.forecast_rows(tiered(spark, sf), MODEL), "comparison_date", *TARGET)


@register("forecast_targets", oracle(f"""
  select commodity, market_id, origin_date, target_date, lead_days, target_offset_days
  from ({FORECAST_SQL.format(history='history', featured='featured')})""", "featured"))
def forecast_targets(spark, sf):
    return X.forecast_rows(tiered(spark, sf), MODEL).select(
        "commodity", "market_id", "origin_date", "target_date", "lead_days", "target_offset_days"
    )


# columns of an origin that exist before a target is chosen
_CATEGORIES = X.CATEGORICAL_FEATURES
_NUMBERS = ("current_price", "lag_7d", "rolling_mean_30d", "relative_volatility_30d", "reporting_gap_days", "current_arrivals")


@register("encode_features", oracle(f"""
  with base as (select *, case when current_arrivals_missing = 1 then null else current_arrivals end as seen_arrivals,
      report_number % 7 = 0 as fresh from featured where report_number >= 9),
  known as (select * from base where origin_date < date '2001-01-01'),
  {', '.join(f"m_{c} as (select {c} as label, row_number() over (order by {c}) - 1 as code from (select distinct {c} from known))" for c in _CATEGORIES)}
  select b.commodity, b.market_id, b.origin_date,
    {', '.join(f"coalesce(m_{c}.code, -1) as {c}_code" for c in _CATEGORIES)},
    {', '.join(rnd(f"coalesce(b.{'seen_arrivals' if c == 'current_arrivals' else c}, (select median({'seen_arrivals' if c == 'current_arrivals' else c}) from known))", 4) + f" as {c}" for c in _NUMBERS)}
  from base b {' '.join(f"left join m_{c} on m_{c}.label = b.{c}" for c in _CATEGORIES)}""", "featured"))
def encode_features(spark, sf):
    rows = X.origins(tiered(spark, sf), MODEL).withColumn(
        "current_arrivals", F.when(F.col("current_arrivals_missing") != 1, F.col("current_arrivals"))
    ).select("origin_date", *_CATEGORIES, *_NUMBERS)
    rows = write_and_reload(rows, "origins")
    known = rows.filter(F.col("origin_date") < F.lit("2001-01-01").cast("date"))
    done = M.encoded(rows, M.category_codes(known, _CATEGORIES), M.numeric_medians(known, _NUMBERS), _CATEGORIES, _NUMBERS)
    return done.select(
        "commodity", "market_id", "origin_date", *(f"{c}_code" for c in _CATEGORIES),
        *(rounded(F.col(c), 4).alias(c) for c in _NUMBERS),
    )
