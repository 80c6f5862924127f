"""A part of many short recordings is written by several tasks."""

from pyspark.sql import functions as F

from parley.operators import decisions as dc


def test_recordings_of_one_part_are_spread(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").cast("string").alias("session_id"), F.lit(0).alias("seg_pos"), F.lit(0).alias("part"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dc._write(rows, str(tmp_path), "words", "r", ["seg_pos"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    written = spark.read.parquet(f"{tmp_path}/words/run=r")
    assert written.count() == 400 and len(written.inputFiles()) > 1
