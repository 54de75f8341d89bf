"""Number parsing, rounding and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted number spelling: sign, digits (single underscores between digits allowed), exponent.
NUMBER_PATTERN = (
    r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding that agrees across engines: settle on six decimals first, where the number fits that."""
    settled = F.round(value.try_cast("decimal(18,6)"), digits).cast("double")
    return F.coalesce(settled, F.round(value.cast("double"), digits))


def parse_number(text: Column) -> Column:
    """'1,250.50' -> 1250.5; blank, malformed, NaN and infinite text -> null."""
    cleaned = F.trim(F.replace(text, F.lit(","), F.lit("")))
    number = F.when(
        cleaned.rlike(NUMBER_PATTERN),
        F.replace(cleaned, F.lit("_"), F.lit("")).try_cast("double"),
    )
    # nullif works the number out once; a condition on it and the number itself would parse the text twice
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Divide by at least one."""
    return numerator / F.greatest(denominator, F.lit(1.0))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def price_position(low: Column, price: Column, high: Column) -> Column:
    """Where the price sits inside its band, as a percentage kept within 3..97."""
    width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return clipped((price - low) / width * 100, 3.0, 97.0)


def median_of_sorted(values: Column) -> Column:
    """Middle of a sorted array; the mean of the two middle values when its size is even."""
    size = F.size(values)
    upper = F.get(values, F.floor(size / 2).cast("int"))
    lower = F.get(values, F.floor((size - 1) / 2).cast("int"))
    return (lower + upper) / 2.0
