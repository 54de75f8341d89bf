import os
import time

from pyspark.sql import functions as F

from bazaarflow.session import write_and_reload


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for top in folders for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffle_files(spark), spark.conf.get(setting)
    frame = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.collect_list("id").alias("ids"))
    stored = write_and_reload(frame, "grouped")
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(setting) == was
    # a frame that was stored can be used again, and collected twice
    assert stored.count() == frame.count() == 97
    assert len(frame.collect()) == len(frame.collect()) == 97
