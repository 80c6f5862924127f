"""Detectors and their written sections: what is due is run, and exactly those sections are replaced.

A section is what one detector found in one recording. The ledger says from which transcript and
settings each section was made, and in which run. Runs are written beside each other and count only
once they are committed, so a scan that dies at any point leaves the sections as they were.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parley.operators.incremental import session_fingerprints
from parley.session import staged

FLAG = "session_id string, seg_pos int, word_index int, kind string, detail string"
LEDGER = ("session_id string, detector_id string, label string, failure_mode string, version string, fp string, config string, "
          "judge_applied boolean, n_word_tokens long, n_flags long, run_at timestamp, run_no long")
COMMIT = "run_no long, run string"
BLOCK = 4096


@dataclass(frozen=True)
class Detector:
    """A detector: ``run(words, judge)`` gives flags (``FLAG``) of the recordings in ``words``.

    ``config`` is the fingerprint of its settings, None without any. ``judge`` reaches those that
    accept one. Detectors that are ``offline_only`` run where the caller asks for them.
    """

    id: str
    label: str
    failure_mode: str
    version: str
    run: Callable[[DataFrame, DataFrame | None], DataFrame]
    config: str | None = None
    accepts_judge: bool = False
    offline_only: bool = False


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table, empty where nothing is written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The latest committed section of each (recording, detector): ``LEDGER`` and its run."""
    commits = read_or_empty(spark, f"{path}/commits", COMMIT).select("run")
    rows = read_or_empty(spark, f"{path}/ledger", f"{LEDGER}, run string").join(commits, "run", "left_semi")
    rest = [c for c in rows.columns if c not in ("session_id", "detector_id")]
    latest = rows.groupBy("session_id", "detector_id").agg(F.max_by(F.struct(*rest), F.struct("run_no", "run")).alias("_r"))
    return latest.select("session_id", "detector_id", "_r.*")


def flags(spark: SparkSession, path: str) -> DataFrame:
    """The flags of all current sections: detector_id and ``FLAG``."""
    written = read_or_empty(spark, f"{path}/flags", f"{FLAG}, run string, detector_id string")
    return written.join(ledger(spark, path).select("session_id", "detector_id", "run"), ["session_id", "detector_id", "run"], "left_semi").drop("run")


def due(inputs: DataFrame, done: DataFrame, detectors: Sequence[Detector], force: bool = False) -> DataFrame:
    """(inputs, detector_id, config): sections to make, ``inputs`` being one row per recording with its ``fp``.

    A section is fresh where its transcript and its settings are those it was made from.
    """
    offers = F.array(*[F.struct(F.lit(d.id).alias("detector_id"), F.lit(d.config).cast("string").alias("config")) for d in detectors])
    wanted = inputs.withColumn("_d", F.explode(offers)).select(*inputs.columns, "_d.*")
    if force:
        return wanted
    fresh = done.select("session_id", "detector_id", "fp", F.coalesce("config", F.lit("")).alias("_c")).distinct()
    return (wanted.withColumn("_c", F.coalesce("config", F.lit("")))
            .join(fresh, ["session_id", "detector_id", "fp", "_c"], "left_anti").drop("_c").select(*wanted.columns))


def _commit(spark: SparkSession, path: str, run_no: int, run: str) -> None:
    """Make a run count: one row in one file, which appears whole or not at all."""
    spark.createDataFrame([(run_no, run)], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def scan(words: DataFrame, path: str, detectors: Sequence[Detector], force: bool = False, judge: DataFrame | None = None,
         run_offline: bool = False, block: int = BLOCK) -> list[str]:
    """Run the detectors that are due on the recordings of ``words``; returns their ids.

    Only recordings whose transcript or settings changed are read by a detector, and only their
    sections are replaced; recordings without a finding get an empty section. Sections of
    detectors that are not offered, and of recordings not in ``words``, stay. Where nothing is due
    no detector is planned and nothing is written.
    """
    spark = words.sparkSession
    offered = [d for d in detectors if run_offline or not d.offline_only]
    sizes = words.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_word_tokens"))
    inputs = staged(session_fingerprints(words, block).join(sizes, "session_id"))
    sections = staged(due(inputs, ledger(spark, path), offered, force))
    named = {r["detector_id"] for r in sections.select("detector_id").distinct().collect()}
    todo = [d for d in offered if d.id in named]
    if not todo:
        return []
    last = read_or_empty(spark, f"{path}/commits", COMMIT).agg(F.max("run_no")).first()[0]
    run_no, run = (last or 0) + 1, uuid4().hex
    for d in todo:
        mine = words.join(sections.filter(F.col("detector_id") == d.id).select("session_id"), "session_id", "left_semi")
        found = d.run(mine, judge if d.accepts_judge else None)
        columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FLAG.split(", ")]
        found.select(*columns).write.parquet(f"{path}/flags/run={run}/detector_id={d.id}")
    facts = F.create_map(*[x for d in todo for x in (F.lit(d.id), F.struct(
        F.lit(d.label).alias("label"), F.lit(d.failure_mode).alias("failure_mode"), F.lit(d.version).alias("version"),
        F.lit(d.accepts_judge and judge is not None).alias("judge_applied")))])
    counts = (spark.read.schema(f"{FLAG}, detector_id string").parquet(f"{path}/flags/run={run}")
              .groupBy("session_id", "detector_id").agg(F.count(F.lit(1)).alias("n_flags")))
    stamps = (sections.join(counts, ["session_id", "detector_id"], "left").withColumn("_f", F.element_at(facts, F.col("detector_id")))
              .select("*", "_f.*").withColumns({"n_flags": F.coalesce("n_flags", F.lit(0).cast("long")), "run_at": F.current_timestamp(),
                                                "run_no": F.lit(run_no).cast("long")}))
    stamps.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.parquet(f"{path}/ledger/run={run}")
    _commit(spark, path, run_no, run)
    return [d.id for d in todo]


def is_stale(words: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """(session_id, detector_id, stale): sections made from another transcript than the recording has now."""
    now = session_fingerprints(words, block).withColumnRenamed("fp", "_now")
    return ledger(words.sparkSession, path).join(now, "session_id", "left").select(
        "session_id", "detector_id", (~F.col("fp").eqNullSafe(F.col("_now"))).alias("stale"))
