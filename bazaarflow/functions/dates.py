"""Date parsing, calendar parts and month ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The date spellings found in the source, tried in this order.
DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy")


def parse_report_date(text: Column) -> Column:
    """The first of the spellings that fits. A spelling is only tried on texts that it may fit: a parse that fails costs many times one that doesn't."""
    cleaned = F.trim(text)
    slashed = F.contains(cleaned, F.lit("/"))
    # four digits at least, after a sign perhaps
    year_first = F.instr(F.substring(cleaned, 2, 1 << 30), "-") >= 4
    may_fit = dict(zip(DATE_FORMATS, (slashed, ~slashed & year_first, ~slashed)))
    return F.coalesce(*(F.when(may_fit[form], F.try_to_date(cleaned, form)) for form in DATE_FORMATS))


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def week_start(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def iso_week_key(day: Column) -> Column:
    return F.concat_ws(
        "-W",
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def months_between(bounds: DataFrame) -> DataFrame:
    """Every month from start_date to end_date of each row, both included."""
    first, last = F.trunc("start_date", "MM"), F.trunc("end_date", "MM")
    months = bounds.select(
        F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month_start")
    )
    return months.select(
        F.year("month_start").alias("year"),
        F.month("month_start").alias("month"),
        month_key(F.col("month_start")).alias("month_key"),
    )


def refresh_start(end: Column) -> Column:
    """A refresh re-reads the previous month and the current one."""
    return F.add_months(F.trunc(end, "MM"), -1)


def utc_instant(local: Column) -> Column:
    """Instant of a zone-less timestamp read as UTC, whatever the session time zone is."""
    return F.concat(local.cast("string"), F.lit("+00:00")).cast("timestamp")


def utc_date(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86_400).cast("int"))
