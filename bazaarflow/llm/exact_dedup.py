"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Rows are combined three times, each time by digest *and* full text, so texts that only share a
digest stay apart:

1. inside each map task (Spark's partial aggregate below the first exchange),
2. per digest and salt, where the salt is the map task's number, so a text that makes up a third
   of the table is merged by many tasks,
3. over the salt winners.

The decision travels back to the rows by digest. Groups above one ten-thousandth of the rows, of
which there are at most ten thousand, are broadcast; the rest joins by shuffle. Rows whose digest
belongs to several texts are decided by a join that compares the text itself.

Defined cases: a null text counts as empty. Null ids are smaller than any other id; a group of null
ids only keeps them all. Rows that repeat an id and its text all count in `group_size` and carry the
same decision. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.names import free
from bazaarflow.session import write_and_reload

SALTS = 16
HOT_GROUPS = 10_000


def _texts(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), sha.alias("sha")).withColumn(
        "digest", F.substring("sha", 1, digest_bytes)
    )


def _winners(texts: DataFrame) -> DataFrame:
    """(digest, text, keep_id, group_size), one row for each different text."""
    local = texts.withColumn("salt", F.spark_partition_id() % SALTS)
    salted = local.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def repeated_contents(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored winners of repeated texts (digest, keep_id, group_size), and digests that several texts share."""
    stored = write_and_reload(_winners(texts).select("digest", "keep_id", "group_size"), "contents")
    shared = stored.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    return stored.filter("group_size > 1"), shared


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, sha (binary SHA-256 of the text)."""
    texts = _texts(docs, id_col, text_col, digest_bytes)
    repeated, shared = repeated_contents(texts)
    rows = texts.select("id", "sha", "digest")
    if shared.isEmpty():
        found = joined(rows, repeated, docs.count())
    else:
        found = joined(rows.join(shared, "digest", "left_anti"), repeated.join(shared, "digest", "left_anti"), docs.count())
        mixed = texts.join(shared, "digest", "left_semi")
        found = found.unionByName(
            mixed.join(_winners(mixed), ["digest", "text"]).select("id", "sha", "keep_id", "group_size")
        )
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def joined(rows: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """rows (id, digest and other columns), less digest, with keep_id and group_size of their digest in repeated."""
    others = [c for c in rows.columns if c != "digest"]
    is_hot = F.col("group_size") * HOT_GROUPS > total
    hot = F.broadcast(repeated.filter(is_hot).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"), F.lit(True).alias("hot")))
    cold = repeated.filter(~is_hot).select(F.col("digest").alias("route"), F.col("keep_id").alias("cold_id"), F.col("group_size").alias("cold_size"))
    # rows that have their answer are dealt out by id, where they meet nothing
    route = F.when(F.col("hot"), F.unhex(F.md5(F.concat(F.lit("hot"), F.col("id").cast("string"))))).otherwise(F.col("digest"))
    size = F.coalesce("hot_size", "cold_size", F.lit(1).cast("long"))
    answer = F.when(F.col("hot"), F.col("hot_id")).when(F.col("cold_size").isNotNull(), F.col("cold_id")).otherwise(F.col("id"))
    return (
        rows.join(hot, "digest", "left").withColumn("route", route).join(cold, "route", "left")
        .select(*others, answer.alias("keep_id"), size.alias("group_size"))
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts the one with the largest id, once."""
    dedup_id, dedup_sha, stay_sha = free(docs, "dedup_id", "dedup_sha", "stay_sha")
    stay = decisions(docs, id_col, text_col).filter("kept").select(F.col("id").alias(dedup_id), F.col("sha").alias(stay_sha))
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    found = docs.withColumn(dedup_sha, sha).join(
        stay.distinct(), F.col(id_col).eqNullSafe(F.col(dedup_id)) & (F.col(dedup_sha) == F.col(stay_sha)), "left_semi",
    )
    return found.dropDuplicates([id_col, dedup_sha]).select(*docs.columns)
