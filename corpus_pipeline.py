"""Corpus pipeline: documents to a mixed and tokenised corpus, stage by stage.

Every stage works on all rows that the one before kept and returns the columns it got; the last one returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.llm import bpe_chunks, exact_dedup, jaccard_join, language_id, mixing
from bazaarflow.llm.queries import tokenizer_path
from bazaarflow.session import write_and_reload


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in which no language can be recognised: no text or no letter at all."""
    return language_id.accepted(docs, language_id.fit(docs.select("doc_id", "text", "lang")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts keep the one with the largest id."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles keep the one with the smallest id."""
    return jaccard_join.representatives(docs, jaccard_join.Scheme(width=5, share=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that all sources weigh the same, in shuffled order."""
    return mixing.mixed(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to."""
    found = bpe_chunks.encoded(docs, tokenizer_path(), carry=("lang", "source"))
    return found.select(F.col("id").alias("doc_id"), "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language id", language), ("exact dedup", exact), ("near duplicates", near), ("mix sources", mix), ("tokenize", tokenize)]

#: the language model, connected components and the tokenizer are beyond SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_reload(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
