"""Merge refreshed rows into published ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HISTORY_KEY = ("market_id", "commodity", "date")
LEDGER_KEY = ("state_id", "commodity", "source_month")


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest `order` per key.

    A combined maximum, so many rows of one key shrink before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("kept"))
        .select(*keys, "kept.*")
    )


def keep_last(published: DataFrame, refreshed: DataFrame, keys: Sequence[str] = HISTORY_KEY,
              tie_breaks: Sequence[str] = ()) -> DataFrame:
    """Union by name and keep, per key, the row of the newest batch.

    `tie_breaks` order several rows of one key inside a batch; the largest wins.
    """
    merged = published.withColumn("_batch", F.lit(0)).unionByName(
        refreshed.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    return one_per_key(merged, keys, ["_batch", *tie_breaks]).drop("_batch")


def newest_days(history: DataFrame, days: int, end: Column | None = None) -> DataFrame:
    """Rows of the last `days` days; the end date is a scalar subquery, not a join, unless it is given."""
    end = history.select(F.max("date")).scalar() if end is None else end
    return history.filter(F.col("date") >= F.date_sub(end, days - 1))


def repeated_keys(history: DataFrame, keys: Sequence[str] = HISTORY_KEY) -> DataFrame:
    return history.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


# --- change detection ------------------------------------------------------

def content_hashes(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "source_sha256") -> DataFrame:
    """A hash of the rows of each key that changes with their content, not with their order.

    Rows are folded to a count, a sum and an exclusive or of 60-bit row hashes, which combine before the shuffle.
    """
    kinds = dict(rows.dtypes)
    text = lambda c: F.coalesce((F.col(c).cast("decimal(18,4)") if kinds[c] == "double" else F.col(c)).cast("string"), F.lit("-"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *map(text, columns)).cast("binary")), 1, 15), 16, 10).cast("long")
    folded = rows.withColumn("_h", number).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"), F.bit_xor("_h").alias("_x"))
    return folded.select(*keys, F.sha2(F.concat_ws("|", "_n", "_s", "_x").cast("binary"), 256).alias(name))


def changed_keys(published: DataFrame, current: DataFrame, keys: Sequence[str] = LEDGER_KEY, hash_col: str = "source_sha256") -> DataFrame:
    """Rows of current whose hash differs from the published one, or whose key is new. Keys that are gone don't count."""
    known = published.select(*keys, F.col(hash_col).alias("_known"))
    return current.join(known, list(keys), "left").filter(~F.col(hash_col).eqNullSafe(F.col("_known"))).drop("_known")
