"""Connected components by alternating large-star and small-star steps, entirely in joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarflow.session import write_and_reload


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node link to the smallest one around it."""
    around = _both_ways(edges)
    return around.join(_least(around), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v")))


def _state(edges: DataFrame) -> tuple:
    pair = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(pair)).first())


def labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (u, v); label is the smallest node of its component."""
    edges = write_and_reload(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before = _state(edges)
    while True:
        edges = write_and_reload(_small_star(_large_star(edges)).distinct(), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
