"""Exact quantiles of groups of any size, without holding a group in one task.

Values are first counted per distinct value, then per coarse band of values. The band counts alone
tell in which band each wanted rank lies, so only the values of those bands are ordered. The
number of bands per group is bounded by the value range (a band is about a tenth of a percent
wide), never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarflow.session import write_and_reload

_BANDS_PER_UNIT = 1000


def _band(value: Column) -> Column:
    """A monotone whole number for a double."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * _BANDS_PER_UNIT)).cast("long")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str,
                    probabilities: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group: columns `keys`, `n` and one per probability.

    Null key columns form their own group, as in a grouped aggregate.
    """
    keys = list(keys)
    valued = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count("*").alias("_count"))
        .withColumn("_band", _band(F.col("_value")))
    )
    bands = valued.groupBy(*keys, "_band").agg(F.sum("_count").alias("_rows"))
    targets = _targets(bands, keys, probabilities).select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_band").alias("_k_band"), "_before", "n", "_wanted"
    )
    # null-safe on every column, so the optimizer adds no filters and `valued` is shuffled once
    same = F.col("_band").eqNullSafe(F.col("_k_band"))
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return _picked(valued.join(targets, same), keys, probabilities)


def rolled_quantiles(rows: DataFrame, levels: dict[str, Sequence[str]], value: str,
                     probabilities: dict[str, float], key: Callable[[str], Column]) -> DataFrame:
    """The same for groups of several levels at once: columns `level`, `interval_key`, `n` and one per probability.

    Levels run from fine to coarse. Band counts are taken from the rows once for each level that no
    earlier one covers; every other level adds up the counts of the last level that holds all its columns.
    A row is then looked up, by its own band, among the few bands that hold a wanted rank, and only
    rows of such bands are unfolded to their levels. `key` names a row's group on a level, never null,
    with the level in it.
    """
    banded = rows.filter(F.col(value).isNotNull()).withColumn("_value", F.col(value)).withColumn("_band", _band(F.col(value)))
    counts: dict[str, DataFrame] = {}
    for level, columns in levels.items():
        finer = [f for f in counts if set(columns) <= set(levels[f])]
        if finer:
            counts[level] = counts[finer[-1]].groupBy(*columns, "_band").agg(F.sum("_rows").alias("_rows"))
        else:
            counted = banded.groupBy(*columns, "_band").agg(F.count("*").alias("_rows"))
            counts[level] = write_and_reload(counted, "bands")
    named = [c.groupBy(F.lit(level).alias("level"), key(level).alias("interval_key"), "_band").agg(F.sum("_rows").alias("_rows"))
             for level, c in counts.items()]
    group = ["level", "interval_key"]
    targets = write_and_reload(_targets(reduce(DataFrame.unionByName, named), group, probabilities), "target-bands")
    found = banded.select("_value", "_band", *(key(level).alias(f"_at_{level}") for level in levels))
    for level in levels:
        part = targets.filter(F.col("level") == level).select(
            F.col("interval_key").alias(f"_key_{level}"), F.col("_band").alias(f"_band_{level}"),
            F.struct("level", "interval_key", "n", "_before", "_wanted").alias(f"_in_{level}"),
        )
        same = (F.col(f"_at_{level}") == F.col(f"_key_{level}")) & (F.col("_band") == F.col(f"_band_{level}"))
        found = found.join(part, same, "left").drop(f"_at_{level}", f"_key_{level}", f"_band_{level}")
    unfolded = found.select("_value", "_band", F.inline(F.array_compact(F.array(*(f"_in_{level}" for level in levels)))))
    valued = unfolded.groupBy(*group, "_band", "n", "_before", "_value").agg(
        F.count("*").alias("_count"), F.first("_wanted").alias("_wanted")
    )
    return _picked(valued, group, probabilities)


def _targets(bands: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Of the counted bands (keys, _band, _rows) those that hold a wanted rank: _before, n and _wanted are added."""
    upward = Window.partitionBy(*keys).orderBy("_band")
    placed = (
        bands.withColumn("_upto", F.sum("_rows").over(upward))
        .withColumn("n", F.sum("_rows").over(Window.partitionBy(*keys)))
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
    )
    # floor and ceiling of every wanted 0-based rank
    wanted = F.array(*(
        F.struct(
            F.lit(name).alias("name"),
            F.floor((F.col("n") - 1) * p).alias("low"),
            F.ceil((F.col("n") - 1) * p).alias("high"),
            ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)).alias("part"),
        )
        for name, p in probabilities.items()
    ))
    inside = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_upto"))
    return (
        placed.withColumn("_wanted", F.filter(wanted, lambda w: inside(w["low"]) | inside(w["high"])))
        .filter(F.size("_wanted") > 0)
        .select(*keys, "_band", "_before", "n", "_wanted")
    )


def _picked(valued: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles from the counted values of the bands that hold a wanted rank."""
    in_band = Window.partitionBy(*keys, "_band").orderBy("_value")
    ranked = (
        valued.withColumn("_last", F.col("_before") + F.sum("_count").over(in_band))
        .withColumn("_first", F.col("_last") - F.col("_count"))
        .select(*keys, "n", "_value", "_first", "_last", F.explode("_wanted").alias("_w"))
    )
    held = lambda rank: (F.col(rank) >= F.col("_first")) & (F.col(rank) < F.col("_last"))
    picked = ranked.groupBy(*keys, "n").agg(*(
        agg
        for name in probabilities
        for agg in (
            F.max(F.when((F.col("_w.name") == name) & held("_w.low"), F.col("_value"))).alias(f"_{name}_low"),
            F.max(F.when((F.col("_w.name") == name) & held("_w.high"), F.col("_value"))).alias(f"_{name}_high"),
            F.max(F.when(F.col("_w.name") == name, F.col("_w.part"))).alias(f"_{name}_part"),
        )
    ))
    return picked.select(*keys, "n", *(
        (F.col(f"_{name}_low") * (1 - F.col(f"_{name}_part")) + F.col(f"_{name}_high") * F.col(f"_{name}_part")).alias(name)
        for name in probabilities
    ))
