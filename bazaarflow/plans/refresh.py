"""Source reports to published history: validate, aggregate, merge, score, select."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.operators import coverage as C
from bazaarflow.operators import validate as V
from bazaarflow.operators.market_day import market_days
from bazaarflow.operators.series import LOOKBACK_REPORTS, by_report, with_anomaly
from bazaarflow.operators.upsert import HISTORY_KEY, LEDGER_KEY, changed_keys, content_hashes, keep_last, newest_days, one_per_key
from bazaarflow.session import in_pass, passes, write_and_reload, write_passes
from bazaarflow.settings import QualitySettings
from bazaarflow.sources import raw_json, reference_dims

# Order of two rows of one key inside a batch: a series keeps one row per date.
SPELLING = ("market", "district")


@dataclass(frozen=True)
class Refreshed:
    history: DataFrame
    coverage: DataFrame
    published: DataFrame
    published_coverage: DataFrame


def source_reports(spark: SparkSession, paths, reference_path: str, states: DataFrame,
                   commodities: DataFrame, quality: QualitySettings,
                   legacy_state_id: int | None = None) -> DataFrame:
    """Nested documents to resolved reports in file order.

    `states` (state_id, state, state_position) and `commodities` (commodity_slug, commodity,
    commodity_position) are the configured dimensions.
    """
    documents = raw_json.located(raw_json.read_documents(spark, paths), legacy_state_id)
    documents = raw_json.within_months(documents, F.lit(quality.start_date), F.lit(quality.end_date))
    chosen = raw_json.latest_layout(documents.drop("markets", "success"))
    documents = documents.join(chosen.select("source_file"), "source_file", "left_semi")
    documents = documents.join(states, "state_id").join(commodities, "commodity_slug")
    markets, districts = reference_dims.read_reference(spark, reference_path)
    entries = reference_dims.resolve_markets(
        raw_json.market_entries(documents),
        reference_dims.market_lookup(markets),
        reference_dims.district_lookup(districts),
    )
    return raw_json.flattened(entries)


def accepted_history(reports: DataFrame, position: Sequence[str], quality: QualitySettings,
                     market: str = "market") -> DataFrame:
    checked = V.validated(reports, quality.start_date, quality.end_date, quality.maximum_price, market)
    return market_days(V.first_copies(checked, position), deduplicated=True)


def one_row_per_day(days: DataFrame) -> DataFrame:
    """Two spellings of a market on one day are two market-days; a series keeps one of them."""
    return one_per_key(days, HISTORY_KEY, SPELLING)


def merged_history(published: DataFrame, refreshed: DataFrame, quality: QualitySettings) -> DataFrame:
    """Refreshed market-days replace published ones; unchanged rows keep their published score.

    A row is scored anew when it, or one of the reports its score looks back on, was refreshed. All
    published rows are still there as context then; the history window is cut last.
    """
    scores = ["anomaly_score", "is_anomaly"]
    known = published if "anomaly_score" in published.columns else with_anomaly(published)
    kept = known.withColumnsRenamed({c: f"_{c}" for c in scores}).withColumn("_fresh", F.lit(0))
    merged = keep_last(kept, refreshed.withColumn("_fresh", F.lit(1)), tie_breaks=SPELLING)
    touched = F.max("_fresh").over(by_report().rowsBetween(-LOOKBACK_REPORTS, 0)) == 1
    scored = with_anomaly(merged.withColumn("_touched", touched))
    final = scored.withColumns({c: F.when(F.col("_touched"), F.col(c)).otherwise(F.col(f"_{c}")) for c in scores})
    ends = [frame.select(F.max("date")).scalar() for frame in (published, refreshed)]
    return newest_days(final, quality.history_days, F.greatest(*ends)).drop("_fresh", "_touched", *(f"_{c}" for c in scores))


def refreshed(history: DataFrame, quality: QualitySettings) -> Refreshed:
    """Coverage, selection and the published subset of a scored history.

    History and coverage are stored once; the four tables written from them don't compute them again.
    """
    history = write_and_reload(history, "refreshed")
    coverage = write_and_reload(C.with_selected(C.series_coverage(history, quality), quality.series_per_group), "coverage")
    selected = coverage.filter("selected")
    return Refreshed(history, coverage, C.restricted_to(history, selected), selected)


def write_refreshed(result: Refreshed, folder: str) -> None:
    """zstd Parquet, rows of a series stored together."""
    ordered = ("state", "commodity", "market", "date")
    for name, frame, keys in (
        ("all_market_history", result.history, ordered),
        ("market_history", result.published, ordered),
        ("all_market_coverage", result.coverage, ordered[:3]),
        ("market_coverage", result.published_coverage, ordered[:3]),
    ):
        frame.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


# --- the refresh as one job ------------------------------------------------

# what a report's content is, for change detection
CONTENT = ("market_id", "market", "district", "commodity", "variety", "date", "min_price", "max_price", "modal_price", "arrivals_tonnes")


@dataclass(frozen=True)
class Changes:
    """What a refresh found in the sources that changed: their keys, every report with its reason, and the ledger."""

    sources: DataFrame
    marked: DataFrame
    ledger: DataFrame

    def rejected(self) -> DataFrame:
        return V.split(self.marked)[1]


def changes(sources: DataFrame, ledger: DataFrame, position: Sequence[str], quality: QualitySettings,
            hashes: DataFrame | None = None) -> Changes:
    """Validate the sources whose content hash isn't the one in the published ledger, and merge the ledgers.

    sources: reports of all source files, stored in a folder for each `source_month`. hashes: (state_id, state, commodity,
    source_month, source_sha256), from the files' ledger for example; computed from the reports if it isn't given. Only
    folders of months with a change are read then, and in them only the changed sources' rows go on. The months, one value
    for each folder, are the only thing the driver gets. Copies are sought in passes over the reports, as their shuffles hold
    every report; copies of a report are in one pass.
    """
    keys = list(LEDGER_KEY)
    found = content_hashes(sources, ["state", *keys], CONTENT) if hashes is None else hashes
    changed = write_and_reload(changed_keys(ledger, found), "changed")
    months = sorted(r["source_month"] for r in changed.select("source_month").distinct().collect())
    read = sources.filter(F.col("source_month").isin(months))
    fresh = read.join(changed.select(*keys), keys, "left_semi")
    checked = V.validated(fresh, quality.start_date, quality.end_date, quality.maximum_price)
    n = passes(read.count())
    marked = write_passes([V.with_duplicates_marked(checked.filter(in_pass(i, n, *V.DUPLICATE_KEY)), position) for i in range(n)], "marked")
    counted = V.quality_ledger(marked, changed, keys)
    return Changes(changed, marked, keep_last(ledger, counted, LEDGER_KEY))


def refresh_all(spark: SparkSession, folder: str, sources: DataFrame, position: Sequence[str], quality: QualitySettings, target: str) -> Refreshed:
    """The weekly job: changed sources into the published tables below folder, as a new publication below target.

    Reads the published ledger and history, writes ledger, rejected reports, history, coverage and their published parts.
    Stops, with the published folder untouched, if no series meets the coverage rules.
    """
    found = changes(sources, spark.read.parquet(f"{folder}/source_quality_ledger"), position, quality)
    accepted, rejected = V.split(found.marked)
    days = market_days(accepted, deduplicated=True)
    result = refreshed(merged_history(spark.read.parquet(f"{folder}/all_market_history"), days, quality), quality)
    if result.published_coverage.isEmpty():
        raise RuntimeError("no market series meets the coverage rules")
    write_refreshed(result, target)
    ordered = found.ledger.repartitionByRange("state", "commodity", "source_month").sortWithinPartitions("state", "commodity", "source_month")
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/source_quality_ledger")
    rejected.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/rejected_records")
    return result
