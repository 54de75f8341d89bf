"""Sizes and hashes of files and folders, as a hash tree.

A file up to `RANGE` bytes has its plain SHA-256. A larger one is cut into ranges of that size, which tasks read and
hash independently; its hash is the SHA-256 of the ranges' hexadecimal digests in order. A folder's hash is made of its
files' names and hashes in two levels: files fall into 256 bins by the hash of their name, so no task holds the list
of a large folder.

So no file is ever one value and none is read by one task alone, however large it is. The listing is Spark's; it reads
no content (content is pruned, and the length is a pushed filter). Small files are read and hashed inside the scan, in any
store that Spark reads. Ranges of larger files are read through Arrow's file systems.

Defined cases: Spark's scans leave out empty files, and so does the ledger. A folder without matching files gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from bazaarflow.schemas import RAW_DOCUMENT
from bazaarflow.sources.raw_json import row_count

RANGE = 64 << 20
_PIECE = 1 << 20


def _listed(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def _hashed_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = pafs.FileSystem.from_uri(row["path"])
            digest, left = hashlib.sha256(), row["size"]
            with system.open_input_file(path) as file:
                file.seek(row["start"])
                while left:
                    piece = file.read(min(left, _PIECE))
                    if not piece:
                        raise OSError(f"{row['path']} became shorter while it was read")
                    digest.update(piece)
                    left -= len(piece)
            yield pa.RecordBatch.from_pylist([{**row, "digest": digest.hexdigest()}])


def file_ledger(spark: SparkSession, path: str | list[str], pattern: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """path, bytes, ranges and sha256 of every file below a path."""
    small = _listed(spark, path, pattern).filter(F.col("length") <= range_bytes).select(
        "path", F.col("length").alias("bytes"), F.lit(1).cast("long").alias("ranges"), F.sha2("content", 256).alias("sha256"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = _listed(spark, path, pattern).filter(F.col("length") > range_bytes).select(
        "path", F.col("length").alias("bytes"), F.explode(starts).alias("start")
    ).withColumn("size", F.least(F.lit(range_bytes).cast("long"), F.col("bytes") - F.col("start")))
    # ranges of one file go to different tasks
    hashed = ranges.repartition("path", "start").mapInArrow(_hashed_ranges, "path string, bytes long, start long, size long, digest string")
    # one digest for each range: 64 characters for each `range_bytes`
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda x: x["digest"]), "")
    large = hashed.groupBy("path", "bytes").agg(F.count("*").alias("ranges"), F.sha2(joined.cast("binary"), 256).alias("sha256"))
    return small.unionByName(large)


def folder_ledger(files: DataFrame, keys: tuple[str, ...] = ("folder",)) -> DataFrame:
    """keys, bytes, files and sha256 of every folder. files: keys, name (inside the folder), bytes, sha256."""
    bin_ = F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 2)
    in_order = lambda column: F.array_sort(F.collect_list(column))
    listed = F.array_join(F.transform(in_order(F.struct("name", "sha256")), lambda x: F.concat(x["name"], F.lit(":"), x["sha256"])), "\n")
    bins = files.withColumn("bin", bin_).groupBy(*keys, "bin").agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.sha2(listed.cast("binary"), 256).alias("digest"))
    whole = F.array_join(F.transform(in_order(F.struct("bin", "digest")), lambda x: x["digest"]), "")
    return bins.groupBy(*keys).agg(
        F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.sha2(whole.cast("binary"), 256).alias("sha256"))


def partition_ledger(spark: SparkSession, folder: str, keys: tuple[str, ...], pattern: str = "part-*", range_bytes: int = RANGE) -> DataFrame:
    """Bytes, files and hash of every partition folder (`key=value/...`) below a folder, for its manifest.

    Names of written files differ from run to run, so files are named by their place among the folder's hashes: equal
    content gives an equal hash.
    """
    ledger = file_ledger(spark, folder, pattern, range_bytes)
    value = lambda key: F.url_decode(F.regexp_extract("path", f"/{key}=([^/]*)/", 1))
    return folder_ledger(ledger.select(*(value(k).alias(k) for k in keys), F.col("sha256").alias("name"), "bytes", "sha256"), keys)


def source_manifest(spark: SparkSession, path: str, range_bytes: int = RANGE, pattern: str = "*.json") -> DataFrame:
    """Record count, size and hash of each retrieved document."""
    documents = spark.read.schema(RAW_DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    counted = documents.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum(row_count(F.col("markets"))).alias("record_count"))
    return file_ledger(spark, path, pattern, range_bytes).join(counted, "path", "left")
