"""Declared schemas of the source documents and the published tables."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _LONG, _DBL, _BOOL, _DATE = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Price fields arrive as numbers or text, so they are read as text and parsed later.
PRICE_ENTRY = _struct(
    variety=_STR, minimumPrice=_STR, maximumPrice=_STR, modalPrice=_STR, arrivals=_STR
)
DATED_ENTRY = _struct(arrivalDate=_STR, data=T.ArrayType(PRICE_ENTRY))
MARKET_ENTRY = _struct(marketName=_STR, dates=T.ArrayType(DATED_ENTRY))
RAW_DOCUMENT = _struct(success=_BOOL, markets=T.ArrayType(MARKET_ENTRY))

MARKET_DIMENSION = _struct(id=_LONG, mkt_name=_STR, state_id=_LONG, district_id=_LONG)
DISTRICT_DIMENSION = _struct(id=_LONG, district_name=_STR)
REFERENCE_DOCUMENT = _struct(
    data=_struct(
        market_data=T.ArrayType(MARKET_DIMENSION),
        district_data=T.ArrayType(DISTRICT_DIMENSION),
    )
)

VARIETY_REPORT = _struct(
    state_id=_LONG, state=_STR, district=_STR, market_id=_STR, market=_STR, commodity=_STR,
    variety=_STR, date=_DATE, min_price=_DBL, max_price=_DBL, modal_price=_DBL,
    arrivals_tonnes=_DBL, source_file=_STR,
)
REJECTED_REPORT = T.StructType(
    [*VARIETY_REPORT.fields, T.StructField("exclusion_reason", _STR)]
)
SOURCE_LEDGER = _struct(
    state_id=_LONG, state=_STR, commodity=_STR, source_month=_STR, input_records=_LONG,
    accepted_records=_LONG, excluded_records=_LONG, exclusion_reasons_json=_STR,
    source_sha256=_STR,
)
MARKET_DAY = _struct(
    state_id=_LONG, state=_STR, district=_STR, market_id=_STR, market=_STR, commodity=_STR,
    date=_DATE, min_price=_DBL, max_price=_DBL, representative_price=_DBL, arrivals_tonnes=_DBL,
    variety_count=_LONG, example_variety=_STR, example_variety_basis=_STR,
    aggregation_method=_STR, arrival_coverage=_STR,
)
