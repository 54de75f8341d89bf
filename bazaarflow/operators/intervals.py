"""Empirical prediction intervals from signed residuals, with a fallback from fine to coarse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.functions.numbers import rounded
from bazaarflow.operators.quantiles import rolled_quantiles

# Levels from the finest to the coarsest and the columns that form their key.
LEVELS = {
    "market": ("market_id", "lead_days", "volatility_bucket"),
    "state_crop": ("state", "commodity", "lead_days", "volatility_bucket"),
    "crop": ("commodity", "lead_days"),
    "lead": ("lead_days",),
    "__global__": (),
}


def interval_key(level: str) -> Column:
    return F.concat_ws("|", F.lit(level), *(F.col(c).cast("string") for c in LEVELS[level]))


def interval_quantiles(predictions: DataFrame, coverage: float, minimum_samples: dict) -> DataFrame:
    """Lower and upper residual per level and key; thin groups are left out, the global one never."""
    residuals = predictions.select(
        (F.col("actual") - F.col("prediction")).alias("residual"), *sorted({c for columns in LEVELS.values() for c in columns})
    )
    alpha = (1.0 - coverage) / 2.0
    table = rolled_quantiles(
        residuals, LEVELS, "residual", {"lower_residual": alpha, "upper_residual": 1.0 - alpha}, interval_key
    )
    enough = F.col("level") == "__global__"
    for level, size in minimum_samples.items():
        enough = enough | ((F.col("level") == level) & (F.col("n") >= size))
    return table.filter(enough)


def with_interval(rows: DataFrame, quantiles: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Bounds from the finest level that has a calibrated entry.

    One left join per level. Only the lead table, which has at most one row per lead day, carries a
    broadcast hint; the global row is read as scalars.
    """
    joined = rows
    for level in ("market", "state_crop", "crop", "lead"):
        part = quantiles.filter(F.col("level") == level).select(
            F.col("interval_key").alias(f"_key_{level}"),
            F.struct(
                F.lit(level).alias("level"), "lower_residual", "upper_residual", "n"
            ).alias(f"_{level}"),
        )
        if level == "lead":
            part = F.broadcast(part)
        joined = joined.withColumn(f"_at_{level}", interval_key(level)).join(
            part, F.col(f"_at_{level}") == F.col(f"_key_{level}"), "left"
        ).drop(f"_key_{level}", f"_at_{level}")
    whole = quantiles.filter(F.col("level") == "__global__")
    fallback = whole.select(
        F.struct(F.lit("__global__").alias("level"), "lower_residual", "upper_residual", "n")
    ).scalar()
    entry = F.coalesce("_market", "_state_crop", "_crop", "_lead", fallback)
    point = F.col(prediction)
    lower = F.least(point, F.greatest(F.lit(1.0), point + F.col("_entry.lower_residual")))
    upper = F.greatest(point, F.col("lower"), point + F.col("_entry.upper_residual"))
    return (
        joined.withColumn("_entry", entry)
        .withColumn("lower", lower)
        .withColumn("upper", upper)
        .withColumn("interval_level", F.col("_entry.level"))
        .withColumn("calibration_n", F.col("_entry.n"))
        .select(*rows.columns, "lower", "upper", "interval_level", "calibration_n")
    )


def scored_intervals(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "interval_width": F.col("upper") - F.col("lower"),
        "covered": F.col("actual").between(F.col("lower"), F.col("upper")),
    })


def interval_coverage(scored: DataFrame, fields=("state", "commodity", "lead_days", "market")) -> DataFrame:
    """Coverage and mean width overall and per segment."""
    pairs = F.array(
        F.struct(F.lit("overall").alias("field"), F.lit("all").alias("segment")),
        *(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("segment")) for f in fields),
    )
    return (
        scored.select("covered", "interval_width", F.inline(pairs))
        .groupBy("field", "segment")
        .agg(
            F.count("*").alias("n"),
            rounded(F.avg(F.col("covered").cast("double")), 4).alias("empirical_coverage"),
            rounded(F.avg("interval_width"), 2).alias("mean_width"),
        )
    )
