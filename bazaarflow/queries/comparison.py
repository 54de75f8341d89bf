"""Registered queries: comparing net amounts across markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.operators import compare as C
from bazaarflow.queries.base import history, oracle, register, rnd
from bazaarflow.queries.published import PARTS, forecasts, markets

# The markets a user selected; they are compared within each commodity.
KEYS = ("0-0", "1-1", "2-2")
_IN = ", ".join(f"'{k}'" for k in KEYS)
LOT = C.Lot(
    quantity=1.2, unit="tonne", transport_method="per_quintal",
    transport={"0-0": 50.0, "1-1": 35.5, "2-2": 0.0}, other_costs={"1-1": 500.0},
)

PARTS["chosen"] = (f"select * from history where market_id in ({_IN})", ("history",))
PARTS["shared_dates"] = (f"select commodity, date from chosen group by 1, 2 having count(distinct market_id) = {len(KEYS)}", ("chosen",))
PARTS["observed"] = ("""
  select c.commodity, c.market_id as key, market, c.date as source_date, c.date as target_date, representative_price as price,
    min_price as low_price, max_price as high_price
  from chosen c join (select commodity, max(date) as date from shared_dates group by 1) using (commodity, date)""", ("chosen", "shared_dates"))
_Q, _T = "12.0::double", "(case key when '0-0' then 50 when '1-1' then 35.5 else 0 end * 12)::double"
_O = "(case key when '1-1' then 500 else 0 end)::double"
PARTS["amounts"] = (f"""
  select *, {_Q} as quantity_quintals, {_T} as transport_cost, {_O} as other_costs,
    price * 12 as gross, low_price * 12 as gross_low, high_price * 12 as gross_high,
    price * 12 - ({_T} + {_O}) as amount, low_price * 12 - ({_T} + {_O}) as amount_low, high_price * 12 - ({_T} + {_O}) as amount_high
  from observed""", ("observed",))
MONEY = ("quantity_quintals", "transport_cost", "other_costs", "gross", "gross_low", "gross_high", "amount", "amount_low", "amount_high")


def _chosen(spark, sf):
    C.check_selection(list(KEYS))
    return history(spark, sf).filter(F.col("market_id").isin(*KEYS))


def _amounts(spark, sf):
    return C.for_lot(C.observed_prices(_chosen(spark, sf), len(KEYS)), LOT)


@register("cmp_common_dates", oracle("select * from shared_dates", "shared_dates"))
def cmp_common_dates(spark, sf):
    return C.common_dates(_chosen(spark, sf), len(KEYS))


@register("cmp_observed", oracle("select * from observed", "observed"))
def cmp_observed(spark, sf):
    return C.observed_prices(_chosen(spark, sf), len(KEYS))


@register("cmp_forecast", oracle("""
  select commodity, market_id as key, market, observed_date as source_date, forecast_date as target_date, forecast_price as price,
    forecast_low as low_price, forecast_high as high_price from forecasts where target_offset_days = 3""", "forecasts"))
def cmp_forecast(spark, sf):
    return C.forecast_prices(forecasts(spark, sf), 3)


@register("cmp_net_amount", oracle(
    "select commodity, key, target_date, " + ", ".join(f"{rnd(c, 2)} as {c}" for c in MONEY) + " from amounts", "amounts"))
def cmp_net_amount(spark, sf):
    return _amounts(spark, sf).select("commodity", "key", "target_date", *(rounded(F.col(c), 2).alias(c) for c in MONEY))


@register("cmp_rank", oracle(f"""
  select commodity, key, {rnd('amount', 2)} as amount, row_number() over (partition by commodity order by amount desc, amount_low desc, key) as rank
  from amounts""", "amounts"))
def cmp_rank(spark, sf):
    return C.ranked(_amounts(spark, sf)).select("commodity", "key", rounded(F.col("amount"), 2).alias("amount"), "rank")


_FIXED = lambda c, d: f"cast(cast(cast({c} as decimal(18,6)) as decimal(18,{d})) as varchar)"
CSV_SQL = f"""
  select market, strftime(source_date, '%Y-%m-%d') as source_report_date, strftime(target_date, '%Y-%m-%d') as comparison_target_date,
    {_FIXED('price', 2)} as price_rs_per_quintal, {_FIXED('low_price', 2)} as low_price, {_FIXED('high_price', 2)} as high_price,
    {_FIXED('quantity_quintals', 3)} as quantity_quintals, {_FIXED('transport_cost', 2)} as transport_cost_rs,
    {_FIXED('other_costs', 2)} as other_entered_costs_rs, {_FIXED('amount', 2)} as estimated_amount_rs,
    {_FIXED('amount_low', 2)} as estimated_amount_low_rs, {_FIXED('amount_high', 2)} as estimated_amount_high_rs
  from amounts"""


@register("cmp_csv_rows", oracle(CSV_SQL, "amounts"))
def cmp_csv_rows(spark, sf):
    return C.csv_rows(_amounts(spark, sf))


@register("cmp_candidates", oracle("""
  select state, market, district, market_id, commodity, last_date from markets where commodity = 'PROMO'
    and (contains(lower(market), 'nation_2') or contains(lower(district), 'nation_2') or contains(lower(state), 'nation_2'))""", "markets"))
def cmp_candidates(spark, sf):
    return C.candidates(markets(spark, sf), "PROMO", "Nation_2").select("state", "market", "district", "market_id", "commodity", "last_date")
