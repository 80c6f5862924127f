"""Tables written back: parts by day, replaced section by section."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parley.session import staged

DAY, STAMP = "day", "is_stamp"


def with_day(df: DataFrame) -> DataFrame:
    """The recording's day, the first eight letters of its id: one folder per day, not per recording."""
    return df.withColumn(DAY, F.substring("session_id", 1, 8))


def append_raw(df: DataFrame, path: str) -> None:
    """Add raw rows; what is there is never rewritten."""
    with_day(df).write.mode("append").partitionBy(DAY).parquet(path)


def replace_sections(old: DataFrame, new: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` without the processed sections, and ``new`` in their place, which may hold nothing for some of them."""
    return old.join(processed.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def overwrite_sections(spark: SparkSession, new: DataFrame, processed: DataFrame, path: str,
                       keys: Sequence[str] = ("detector_id", "session_id")) -> None:
    """Replace the processed sections of a written table; sections that found nothing are emptied.

    Only the days of processed recordings are read and rewritten. Each processed section leaves a
    stamp row, so that it is known as done and its day has rows to be rewritten with.
    """
    keys = list(keys)
    stamps = processed.select(*keys).distinct().withColumn(STAMP, F.lit(True))
    fresh = with_day(new.withColumn(STAMP, F.lit(False)).unionByName(stamps, allowMissingColumns=True))
    try:
        old = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = fresh
    else:
        days = with_day(stamps).select(DAY).distinct()
        table = staged(replace_sections(old.join(days, DAY, "left_semi"), fresh, processed, keys))
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all sections, stamps left out."""
    return spark.read.parquet(path).filter(~F.col(STAMP)).drop(STAMP, DAY)


def section_stamps(spark: SparkSession, path: str, keys: Sequence[str] = ("detector_id", "session_id")) -> DataFrame:
    """The sections that have run, those with no finding included."""
    return spark.read.parquet(path).filter(STAMP).select(*keys).distinct()


def read_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """All rows of one recording; only its day is read."""
    rows = spark.read.parquet(path).filter((F.col(DAY) == session_id[:8]) & (F.col("session_id") == session_id))
    return rows.filter(~F.col(STAMP)).drop(STAMP, DAY) if STAMP in rows.columns else rows.drop(DAY)
