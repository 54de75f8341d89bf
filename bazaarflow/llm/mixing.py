"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every source gets a mean repetition rate: target share x target rows / own rows. A document's number
of copies is drawn from a Poisson distribution with that mean by inverting its distribution function
at a uniform number hashed from seed and id, so retries and reruns draw the same copies. Rates above
`PART` are drawn as sums of several independent draws, which has the same distribution and keeps
exp(-rate) away from underflow. Copies are exploded and ordered by a hashed key over the whole table.

Only the counts by source are gathered; the rate table has one row for each source. It is stored, so
Spark knows its size and broadcasts it below its threshold or else joins by shuffle. A hot source is never grouped: its rows are only counted with a partial sum.

Defined cases: a null source is a source of its own. A source without a target weight has weight 0
and no copies; a target source without rows is ignored and the others share its weight. Rows that
repeat an id get the same count. Null ids hash as the text 'null'. Input columns named like an
output column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.session import write_and_reload

SEED = "mix-1"
PART = 16.0


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, source_col: str = "source") -> DataFrame:
    """(mix_source, mix_rate) for every source. Without weights all sources weigh the same."""
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    weighted = counts.withColumn("weight", weight)
    sums = weighted.agg(F.sum("weight").alias("w"), F.sum("n").alias("rows")).first()
    rows = total if total is not None else (sums["rows"] or 0)
    share = F.col("weight") / F.lit(sums["w"] or 1.0)
    return weighted.select("mix_source", (share * F.lit(float(rows)) / F.col("n")).alias("mix_rate"))


def _distribution(rate: Column) -> Column:
    """Array of P(count <= k) for k = 0, 1, ... until it is 1 within a double's precision."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["c"])


def uniform(seed: str, *parts: Column) -> Column:
    """48 bits of md5 as a number in (0, 1)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, seed: str = SEED,
          id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs repeated to the target weights and shuffled, with mix_copies, mix_copy (from 1) and mix_key."""
    plain = docs.drop("mix_source", "mix_rate", "mix_copies", "mix_copy", "mix_key", "mix_parts", "mix_cdf")
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / F.lit(PART)).cast("int"))
    table = write_and_reload(rates(plain, weights, total, source_col).withColumn("mix_parts", parts).select(
        "mix_source", "mix_parts", _distribution(F.col("mix_rate") / F.col("mix_parts")).alias("mix_cdf")
    ), "rates")
    ident = F.col(id_col)

    def drawn(part: Column) -> Column:
        return F.size(F.filter("mix_cdf", lambda c: c < uniform(seed, ident, part)))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0), lambda n, part: n + drawn(part))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(ident.cast("string"), F.lit("null")), F.col("mix_copy").cast("string"), F.lit("order")))
    return (
        plain.join(table, F.col(source_col).eqNullSafe(F.col("mix_source")))
        .withColumn("mix_copies", copies).filter("mix_copies > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .withColumn("mix_key", key)
        .select(*plain.columns, "mix_copies", "mix_copy", "mix_key")
        .orderBy("mix_key", id_col)
    )
