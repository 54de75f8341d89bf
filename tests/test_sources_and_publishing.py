import hashlib
import json
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import files as H
from bazaarflow.operators import publish as B
from bazaarflow.operators import validate as V
from bazaarflow.operators.series import with_anomaly
from bazaarflow.plans import outlook, refresh
from bazaarflow.settings import DEFAULTS, Settings
from bazaarflow.sources import raw_json, reference_dims

ENTRY = {"variety": "Red", "minimumPrice": "1,000", "maximumPrice": 1200, "modalPrice": 1100.5, "arrivals": None}
DOCUMENT = {
    "success": True,
    "markets": [
        {"marketName": " PUNE   APMC ", "dates": [
            {"arrivalDate": "20/07/2026", "data": [ENTRY, {**ENTRY, "variety": None, "arrivals": "2.5"}]},
            {"arrivalDate": "2026-07-19", "data": []},
        ]},
        {"marketName": "Nowhere", "dates": [{"arrivalDate": "18-07-2026"}]},
        {"marketName": "Silent"},
    ],
}
REFERENCE = {"data": {
    "market_data": [
        {"id": 5, "mkt_name": "Pune APMC", "state_id": 20, "district_id": 1},
        {"id": 6, "mkt_name": "pune  apmc", "state_id": 20, "district_id": 2},
        {"id": 7, "mkt_name": "", "state_id": 20, "district_id": 2},
        {"id": 8, "mkt_name": "Other", "state_id": 99, "district_id": 2},
    ],
    "district_data": [{"id": 2, "district_name": " Pune "}, {"id": None, "district_name": "x"}],
}}


@pytest.fixture
def raw(tmp_path):
    current, old = tmp_path / "raw" / "20-maharashtra" / "onion", tmp_path / "raw" / "onion"
    current.mkdir(parents=True)
    old.mkdir(parents=True)
    (current / "2026-07.json").write_text(json.dumps(DOCUMENT, indent=1))
    (current / "2023-01.json").write_text(json.dumps(DOCUMENT))
    (old / "2026-07.json").write_text(json.dumps({"markets": []}))
    (old / "2026-06.json").write_text("{}")
    (tmp_path / "filters.json").write_text(json.dumps(REFERENCE))
    return tmp_path


def test_row_counts(spark, raw):
    counts = {r.source_file[-35:]: r.n for r in raw_json.read_documents(spark, str(raw / "raw")).select("source_file", raw_json.row_count(F.col("markets")).alias("n")).collect()}
    assert sorted(counts.values()) == [0, 0, 4, 4]


def test_lookup_keeps_the_last_entry_and_configured_states(spark, raw):
    markets, districts = reference_dims.read_reference(spark, str(raw / "filters.json"))
    rows = reference_dims.market_lookup(markets, [20]).collect()
    assert [(r.market_key, r.reference_id, r.district_id) for r in rows] == [("pune apmc", 6, 2)]
    assert reference_dims.district_lookup(districts).collect()[0].district == "Pune"


def source_reports(spark, raw):
    states = spark.createDataFrame([(20, "Maharashtra", 0)], "state_id long, state string, state_position int")
    crops = spark.createDataFrame([("onion", "Onion", 0)], "commodity_slug string, commodity string, commodity_position int")
    return refresh.source_reports(spark, str(raw / "raw"), str(raw / "filters.json"), states, crops, DEFAULTS.quality, legacy_state_id=20)


def test_documents_become_resolved_reports(spark, raw):
    rows = source_reports(spark, raw).orderBy(*raw_json.POSITION).collect()
    assert [(r.market, r.market_id, r.district, r.date.day, r.variety, r.min_price, r.arrivals_tonnes) for r in rows] == [
        ("Pune APMC", "20-6", "Pune", 20, "Red", 1000.0, None),
        ("Pune APMC", "20-6", "Pune", 20, "Unspecified", 1000.0, 2.5),
        ("Pune APMC", "20-6", "Pune", 19, "Unspecified", None, None),
        ("Nowhere", "derived-20-" + hashlib.sha1(b"nowhere").hexdigest()[:10], "Unknown", 18, "Unspecified", None, None),
    ]


def test_current_layout_overrides_the_old_one_and_months_are_pruned(spark, raw):
    files = source_reports(spark, raw).select("source_file").distinct().collect()
    assert len(files) == 1 and files[0][0].endswith("20-maharashtra/onion/2026-07.json")


def test_reports_validate_into_history(spark, raw):
    reports = source_reports(spark, raw)
    days = refresh.accepted_history(reports, raw_json.POSITION, DEFAULTS.quality, "market_raw").collect()
    assert [(d.market, d.representative_price, d.arrival_coverage) for d in days] == [("Pune APMC", 1100.5, "partial")]
    marked = V.with_duplicates_marked(V.validated(reports, date(2024, 7, 1), date(2026, 7, 20), 250_000.0, "market_raw"), raw_json.POSITION)
    assert {r.exclusion_reason: r.n for r in V.reason_counts(marked).collect()} == {"unparseable_price": 2}


def test_corrections_count_market_entries(spark, raw):
    markets, districts = reference_dims.read_reference(spark, str(raw / "filters.json"))
    documents = raw_json.located(raw_json.read_documents(spark, str(raw / "raw" / "20-maharashtra")), 20).filter("source_month = '2026-07'")
    entries = reference_dims.resolve_markets(raw_json.market_entries(documents), reference_dims.market_lookup(markets), reference_dims.district_lookup(districts))
    row = V.entry_corrections(entries, ["source_month"]).first()
    assert (row.market_entries, row.corrected_records, row.unresolved_market_references) == (3, 1, 2)


def test_file_ledger_and_manifest(spark, raw):
    body = (raw / "raw" / "20-maharashtra" / "onion" / "2026-07.json").read_bytes()
    rows = {r.path.split("/raw/")[1]: r for r in H.source_manifest(spark, str(raw / "raw")).collect()}
    row = rows["20-maharashtra/onion/2026-07.json"]
    assert (row.bytes, row.sha256, row.record_count) == (len(body), hashlib.sha256(body).hexdigest(), 4)
    assert len(rows) == 4


def test_data_version_follows_content_only(spark):
    frame = spark.range(100).withColumn("v", F.col("id") % 7)
    version = B.data_version(frame)
    assert len(version) == 12 and version == B.data_version(frame.repartition(5, "v"))
    assert version != B.data_version(frame.withColumn("v", F.col("v") + 1))


def test_outlook_and_published_partitions(spark, series, tmp_path):
    quality = replace(DEFAULTS.quality, minimum_records=5, minimum_weekly_coverage=0.1, maximum_age_days=30)
    columns = {"variety_count": F.lit(1).cast("long"), "example_variety_basis": F.lit("b"), "aggregation_method": F.lit("m")}
    frame = with_anomaly(series([100 + i % 9 for i in range(300)], market="a").unionByName(series([200 + i % 5 for i in range(300)], market="b")).withColumns(columns))
    result = refresh.refreshed(frame, quality)
    settings = Settings(quality, replace(DEFAULTS.model, folds=3))
    method = outlook.strongest_baseline(result.published, result.published_coverage, settings)
    forecasts = outlook.baseline_forecasts(result.published, result.published_coverage, method, settings)
    rows = forecasts.collect()
    assert len(rows) == 14 and {r.target_offset_days for r in rows} == set(range(1, 8))
    assert all(r.forecast_low <= r.forecast_price <= r.forecast_high for r in rows)
    assert {r.method for r in rows} == {method} and len({r.comparison_date for r in rows}) == 1
    records = B.published_rows(result.published, result.published_coverage, forecasts)
    folder = str(tmp_path / "json")
    B.write_published(records, folder)
    back = spark.read.json(folder)
    assert back.count() == 600 + 2 + 14 + result.published.select("market_id", F.month("date")).distinct().count()
    assert {(r.state_slug, r.commodity_slug) for r in back.select("state_slug", "commodity_slug").distinct().collect()} == {("s", "onion")}
    stats = B.partition_stats(result.published, result.published_coverage, forecasts)
    totals = B.manifest_totals(result.published, result.published_coverage, forecasts)
    manifest = json.loads(B.manifest_document(totals, stats).first()[0])
    assert sum(p["observation_count"] for p in manifest["partitions"]) == manifest["meta"]["observed_records"] == 600
    expected = spark.createDataFrame([("S", "Onion")], "state string, commodity string")
    existing = spark.createDataFrame([("S", "Onion"), ("S", "Gone")], "state string, commodity string")
    assert [r.commodity for r in B.stale_partitions(existing, expected).collect()] == ["Gone"]


def test_forecasts_must_share_one_date(spark):
    from bazaarflow.operators.forecast import common_comparison_date

    with pytest.raises(Exception, match="one comparison date"):
        common_comparison_date(spark.createDataFrame([(date(2026, 1, 1),), (date(2026, 1, 2),)], "comparison_date date")).collect()


def test_documents_are_parsed_once_before_they_are_unfolded(spark):
    """No filter or join condition holds the parser: such a filter parses every document one more time."""
    import re

    from bazaarflow.sources import tables as T

    whole = '{"success":true,"markets":[{"marketName":" A ","dates":[{"arrivalDate":"2-1-2026","data":[]},{"arrivalDate":"2026-01-03"}]},{"marketName":"B"},{"marketName":"C","dates":[]}]}'
    texts = spark.createDataFrame([(1, whole), (2, '{"markets":[]}'), (3, "{}"), (4, None)], "place long, document string")
    named = spark.createDataFrame([(i, f"n{i}") for i in range(1, 5)], "key long, name string")
    documents = T.parsed_documents(texts.join(named, F.col("place") == F.col("key")))
    flat = raw_json.flattened(raw_json.market_entries(documents))
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan
    assert not re.search(r"^[\s:+-]*(Filter|Join)\b.*from_json", plan, re.M)
    rows = [(r.name, r.market_raw, r.date_position, str(r.date), r.variety) for r in flat.collect()]
    assert sorted(rows) == [("n1", "A", 0, "2026-01-02", "Unspecified"), ("n1", "A", 1, "2026-01-03", "Unspecified")]


def test_dates_and_numbers_take_and_refuse_the_same_spellings(spark):
    from bazaarflow.functions import dates, numbers

    spelled = ["0005-3-2020", "-0005-3-2", "+12020-1-2", "2020-1-5", "5-1-2020", "5/1/2020", "0005/1/2020", "1/2-2020", "5-1-0020", "12345-1-1", "", " ", None]
    frame = spark.createDataFrame([(s,) for s in spelled], "t string")
    plain = F.coalesce(*(F.try_to_date(F.trim("t"), form) for form in dates.DATE_FORMATS))
    assert frame.filter(~dates.parse_report_date(F.col("t")).eqNullSafe(plain)).count() == 0
    values = spark.createDataFrame([("1e999",), ("-1e999",), ("-0.0",), ("1e308",), ("x",), (None,)], "t string").select(numbers.parse_number(F.col("t")))
    assert [r[0] for r in values.collect()] == [None, None, 0.0, 1e308, None, None]


def test_manifest_texts_are_measured_before_they_meet_the_manifest(spark, tmp_path):
    """Sizes and hashes are joined, not the texts; every group of documents is one file, null groups too."""
    import bazaarflow.queries as Q

    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    line = lambda order, number, month: (order, 1, 1, number, 2.0, 20.0, 0.1, 0.1, "R", "F", None if month is None else f"1996-{month:02d}-03 00:00:00")
    lines = [line(1, 1, 1), line(1, 3, 1), line(2, 1, 2), line(1_000_001, 1, 1), line(2, 1, 2), line(3, 1, None)]
    spark.createDataFrame(lines, kinds.replace("timestamp_ntz", "string")).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "s", 1)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "n", 4)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    found = Q.load()[0]["src_manifest_files"](spark, str(tmp_path))
    rows = sorted((r.source_month, r.chunk, r.record_count, r.same_bytes, r.same_hash) for r in found.collect())
    assert rows == [("1996-01", 0, 3, True, True), ("1996-01", 1, 1, True, True), ("1996-02", 0, 2, True, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sha2(cast(concat(text")
