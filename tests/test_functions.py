from datetime import date

import pytest
from pyspark.sql import functions as F

from bazaarflow.functions import buckets, dates, numbers, text


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("spelled", ["20/07/2026", "2026-07-20", "20-07-2026", " 20/7/2026 "])
def test_dates_in_every_spelling(spark, spelled):
    assert one(spark, dates.parse_report_date(F.lit(spelled))) == date(2026, 7, 20)


@pytest.mark.parametrize("spelled", ["not-a-date", "", "32/01/2026", "2026/07/20", "07-20-2026"])
def test_bad_dates_are_null(spark, spelled):
    assert one(spark, dates.parse_report_date(F.lit(spelled))) is None


@pytest.mark.parametrize("spelled, number", [
    ("1,250.50", 1250.5), (" 12 ", 12.0), ("1e3", 1000.0), ("-4", -4.0), (".5", 0.5), ("1_000", 1000.0),
    ("nan", None), ("inf", None), ("12d", None), ("", None), ("1e999", None), ("n/a", None), (None, None),
])
def test_numbers(spark, spelled, number):
    assert one(spark, numbers.parse_number(F.lit(spelled).cast("string"))) == number


def test_half_up_rounding_on_decimals(spark):
    assert one(spark, numbers.rounded(F.lit(1.005), 2)) == 1.01
    assert one(spark, numbers.rounded(F.lit(2.675), 2)) == 2.68


@pytest.mark.parametrize("raw, key, shown", [
    ("  PUNE   APMC ", "pune apmc", "Pune APMC"), ("AMRAWATI(FRUIT)", "amrawati(fruit)", "Amrawati(Fruit)"),
    ("Pune  Ap Mc", "pune ap mc", "Pune APMC"), ("Nashik", "nashik", "Nashik"), ("Straße", "strasse", "Straße"),
])
def test_names(spark, raw, key, shown):
    assert one(spark, text.normalized_key(F.lit(raw))) == key
    assert one(spark, text.display_name(F.lit(raw))) == shown


def test_unicode_spaces_collapse(spark):
    assert one(spark, text.normalized_key(F.lit(" A  B\t"))) == "a b"


def test_variety_defaults_before_trimming(spark):
    names = [one(spark, text.variety_name(F.lit(v).cast("string"))) for v in (None, "", "   ", " Red  onion ")]
    assert names == ["Unspecified", "Unspecified", "", "Red onion"]


def test_slugs(spark):
    assert one(spark, text.slug(F.lit("Paddy (Common)"))) == "paddy-common"
    assert one(spark, text.ascii_slug(F.lit("Café x"))) == "cafe-x"
    assert one(spark, text.ascii_slug(F.lit("Éa"))) == "e-a"


def test_calendar_parts(spark):
    day = F.lit(date(2024, 12, 31))
    assert one(spark, dates.iso_week_key(day)) == "2025-W01"
    assert one(spark, dates.week_start(day)) == date(2024, 12, 30)


def test_months_are_inclusive(spark):
    bounds = spark.createDataFrame([(date(2024, 11, 30), date(2025, 2, 1))], "start_date date, end_date date")
    assert [r.month_key for r in dates.months_between(bounds).collect()] == ["2024-11", "2024-12", "2025-01", "2025-02"]


def test_refresh_starts_in_the_previous_month(spark):
    assert one(spark, dates.refresh_start(F.lit(date(2026, 3, 31)))) == date(2026, 2, 1)


def test_bands(spark):
    assert [one(spark, buckets.volatility_bucket(F.lit(v))) for v in (0.079, 0.08, 0.2)] == ["stable", "variable", "volatile"]
    assert [one(spark, buckets.freshness(F.lit(v), 7)) for v in (2, 7, 8)] == ["fresh", "recent", "stale"]
    assert one(spark, numbers.price_position(F.lit(10.0), F.lit(10.0), F.lit(10.0))) == 3.0
    assert one(spark, numbers.price_position(F.lit(0.0), F.lit(50.0), F.lit(100.0))) == 50.0


@pytest.mark.parametrize("values, middle", [([5.0, 1.0, 3.0], 3.0), ([4.0, 2.0, 1.0, 3.0], 2.5)])
def test_median_of_sorted(spark, values, middle):
    assert one(spark, numbers.median_of_sorted(F.sort_array(F.array(*map(F.lit, values))))) == middle


def test_ascii_slug_equals_compatibility_decomposition(spark):
    """Every character of the first two planes, between letters."""
    import re
    import unicodedata

    def plain(value):
        return re.sub("(^-|-$)", "", re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", value).lower()))

    codes = [c for c in (*range(0x20, 0xD800), *range(0xE000, 0x20000)) if unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(f"x{chr(c)}Y" for c in codes[i : i + 8]) for i in range(0, len(codes), 8)]
    texts += ["Ｆｕｌｌ ｗｉｄｔｈ", "oﬃce ﬁg ½", "Đà Nẵng, Thừa Thiên Huế", "㎏ ①⑫", "", "---", "Ǆ İstanbul"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.ascii_slug(F.col("t")).alias("s")).collect()
    wrong = [(r.t, r.s, plain(r.t)) for r in found if r.s != plain(r.t)]
    assert not wrong, wrong[:5]


def test_rounding_takes_numbers_of_any_size(spark):
    values = [2.345, -2.345, 1e11 + 0.125, 3e12 + 0.126, 1e200, float("inf"), None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in frame.select(numbers.rounded(F.col("v"), 2)).collect()]
    assert found == [2.35, -2.35, 1e11 + 0.13, 3e12 + 0.13, 1e200, float("inf"), None]


def test_ascii_slug_looks_characters_up_instead_of_trying_them(spark):
    """No expression lists characters one by one; characters of the private range, used inside, only separate."""
    import re

    frame = spark.createDataFrame([("abcd",), ("",), ("éé ﬁ™½Ǆ",), (None,)], "t string").select(text.ascii_slug(F.col("t")).alias("s"))
    classes = re.findall(r"\[[^\[\]]*\]", frame._jdf.queryExecution().analyzed().toString())
    assert classes and max(map(len, classes)) < 20, max(classes, key=len)[:60]
    assert [r.s for r in frame.collect()] == ["a-b-c-d", "", "e-e-fitm1-2dz", None]
