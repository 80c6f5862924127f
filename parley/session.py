"""Session construction and the checkpoint folder."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "parley", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are planned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    On a cluster set it, or a warehouse that all machines share: Spark's default warehouse is a local folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(target)
    return target


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate as Parquet into the checkpoint folder and read it from there.

    For tables read by several branches of a plan: smaller than a checkpoint, and Spark knows their
    size when it plans. They lie under the application's id; nothing removes them when it ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{spark.sparkContext.applicationId}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write a shared intermediate once to the checkpoint folder and read it from there.

    For tables small against the words they come from (forms, flags, events) that a plan reads
    several times; without it the plan would repeat their whole lineage per use.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
