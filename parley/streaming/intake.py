"""Intake of new recordings with Structured Streaming.

A file stream over the inbox manifest feeds ``classify_intake`` batch by batch. Accepted rows are
written under the batch's id, so a batch that is run again replaces its own output and the table of
known recordings stays free of repeats.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parley.operators.incremental import classify_intake

MANIFEST = "uuid string, session_id string, md5 string, path string, ordinal long"


def _known(spark: SparkSession, path: str, before: int, batch: DataFrame) -> DataFrame:
    """Admitted recordings that share a uuid or a time with the batch."""
    try:
        held = spark.read.schema(f"{MANIFEST}, verdict string, batch_id long").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return batch.limit(0)
    new = held.filter((F.col("batch_id") < before) & (F.col("verdict") == "new")).select(*batch.columns)
    by_uuid = new.join(batch.select("uuid").distinct(), "uuid", "left_semi")
    return by_uuid.unionByName(new.join(batch.select("session_id").distinct(), "session_id", "left_semi"))


def intake(spark: SparkSession, inbox: str, recordings: str, checkpoint: str,
           then: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Start the stream: manifests under ``inbox`` become rows of ``recordings``.

    ``then`` gets each batch's new recordings (for the detectors) and its batch id.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        decided = classify_intake(batch, _known(batch.sparkSession, recordings, batch_id, batch)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        decided.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(recordings)
        if then:
            then(batch.sparkSession.read.parquet(recordings).filter((F.col("batch_id") == batch_id) & (F.col("verdict") == "new")), batch_id)
    stream = spark.readStream.schema(MANIFEST).json(inbox)
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
