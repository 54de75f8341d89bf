"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Settings the jobs like. They are only applied to sessions this module builds.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can reach.

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="bazaarflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# Spark's own setting: the shuffle files of a query are removed when it ends, not when the driver collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that start inside leave no shuffle files behind.

    Only for results that are written: a frame that is collected twice would miss its shuffles.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def write_and_reload(frame, purpose: str):
    """Cut lineage with a written table, so a lost executor re-reads files instead of recomputing.

    Nothing reads the query's shuffles after that, so a job of many such tables holds those of one of them at a time.
    """
    path = shared_folder(frame.sparkSession, purpose)
    with shuffles_freed(frame.sparkSession):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


# Rows that a pass shuffles, about, and passes at most: each reads its input once more.
PASS_ROWS, PASSES = 600_000, 6


def passes(rows: int) -> int:
    return min(PASSES, max(1, -(-rows // PASS_ROWS)))


def in_pass(number: int, of: int, *columns: str) -> Column:
    """Is a row in this pass? Rows that are equal in the columns, null or not, are in the same one."""
    return F.pmod(F.xxhash64(*columns), F.lit(of)) == number


def write_passes(frames: list[DataFrame], purpose: str) -> DataFrame:
    """write_and_reload of the frames' union, one after the other, so the disk holds the shuffles of one frame at a time."""
    spark, paths = frames[0].sparkSession, []
    with shuffles_freed(spark):
        for frame in frames:
            paths.append(shared_folder(spark, purpose))
            frame.write.option("compression", "zstd").parquet(paths[-1])
    return spark.read.schema(frames[0].schema).parquet(*paths)
