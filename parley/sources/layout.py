"""Artifact tables laid out for joins without shuffles and for reads of one recording.

Each table is partitioned by the recording's day and bucketed inside it. Words and segments are
bucketed by segment, not by recording, so that one long recording fills all buckets and still joins
and groups by segment where it lies. The small artifacts are bucketed by recording, so a read of one
recording opens one bucket of one day.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.tables import DAY, with_day

SEGMENT = ("session_id", "seg_pos")
RECORDING = ("session_id",)
ARTIFACTS = {"words": SEGMENT, "segments": SEGMENT, "turns": RECORDING, "vectors": RECORDING, "identifications": RECORDING,
             "notes": RECORDING, "labels": RECORDING, "pending": RECORDING}


@dataclass(frozen=True)
class Layout:
    """Where a family of artifact tables lies: ``prefix`` of their names, ``path`` of their files, number of buckets.

    Tables joined with each other must have the same number of buckets. ``by_day`` is off only where
    recording ids don't start with a day.
    """

    prefix: str
    path: str
    buckets: int = 64
    by_day: bool = True

    def name(self, artifact: str) -> str:
        if artifact not in ARTIFACTS:
            raise ValueError(f"unknown artifact {artifact!r}")
        return f"{self.prefix}_{artifact}"


def save(df: DataFrame, layout: Layout, artifact: str, mode: str = "append") -> None:
    """Write rows of an artifact; one file per day and bucket, sorted by the bucket's columns.

    A row's bucket follows from its keys alone, so rows added later lie with the earlier ones.
    """
    keys = ARTIFACTS[artifact] if artifact in ARTIFACTS else ()
    name = layout.name(artifact)
    rows = with_day(df) if layout.by_day else df
    writer = rows.repartition(layout.buckets, *keys).write.mode(mode).option("path", f"{layout.path}/{artifact}")
    writer = writer.partitionBy(DAY) if layout.by_day else writer
    writer.bucketBy(layout.buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)


def artifact(spark: SparkSession, layout: Layout, kind: str) -> DataFrame:
    """All rows of an artifact."""
    rows = spark.table(layout.name(kind))
    return rows.drop(DAY) if layout.by_day else rows


def of_recording(spark: SparkSession, layout: Layout, kind: str, session_id: str) -> DataFrame:
    """The rows of one recording: its day's folder, and of small artifacts its bucket, are read."""
    rows = spark.table(layout.name(kind)).filter(F.col("session_id") == session_id)
    return rows.filter(F.col(DAY) == session_id[:8]).drop(DAY) if layout.by_day else rows


def segment_words(spark: SparkSession, layout: Layout) -> DataFrame:
    """Words with what their segments say of them; no row moves."""
    words = artifact(spark, layout, "words")
    facts = artifact(spark, layout, "segments")
    return words.join(facts.drop(*[c for c in facts.columns if c in words.columns and c not in SEGMENT]), list(SEGMENT))
