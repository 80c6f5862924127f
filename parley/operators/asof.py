"""Nearest row before or after a point in time, per key, without a cross join."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.scans import LastSeen, NextSeen, RunMax, block_of, scan
from parley.session import staged


def asof(probe: DataFrame, build: DataFrame, keys: Sequence[str], at: str, time: str, tie: str,
         payload: Sequence[str], width: int, direction: str = "backward", strict: bool = True,
         prefix: str = "b_") -> DataFrame:
    """Attach the nearest build row to each probe row; no match leaves nulls.

    Probe and build rows are put on one time line and a blocked "last seen" scan walks it. Equal
    build times resolve to the least ``tie``.
    """
    backward = direction == "backward"
    # on equal times the probe sorts first, unless an equal build row has to be seen backward
    # (or must not be seen forward)
    probe_rank = 0 if backward == strict else 2
    tie_sign = -1 if backward else 1
    p = probe.select(*keys, F.col(at).alias("_t"), F.lit(probe_rank).alias("_k"),
                     F.lit(0).cast("long").alias("_tie"), F.struct(*probe.columns).alias("_p"))
    b = build.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_k"),
                     (F.col(tie).cast("long") * tie_sign).alias("_tie"), F.struct(*payload).alias("_b"))
    line = p.unionByName(b, allowMissingColumns=True)
    seen = LastSeen(F.col("_b")) if backward else NextSeen(F.col("_b"))
    found = scan(line, keys, ["_t", "_k", "_tie"], block_of("_t", width), _m=seen)
    return found.filter("_p is not null").select(
        "_p.*", *[F.col("_m")[c].alias(f"{prefix}{c}") for c in payload])


def bracket(probe: DataFrame, build: DataFrame, keys: Sequence[str], payload: Sequence[str], tie: str, width: int,
            before_at: str = "start", after_at: str = "end", time: str = "start") -> DataFrame:
    """Nearest build row before ``before_at`` (strictly) and nearest at or after ``after_at``.

    Each probe row enters the time line at both points, so one scan serves both directions. The scan reads its input
    twice, so probes are numbered and written once; the two points of a probe meet again by its number.
    """
    tie_id = F.col(tie).cast("long")
    probe = staged(probe.withColumn("_id", F.monotonically_increasing_id()))
    columns = probe.columns[:-1]
    point = F.explode(F.array(F.struct(F.col(before_at).alias("t"), F.lit(0).alias("d")),
                              F.struct(F.col(after_at).alias("t"), F.lit(2).alias("d"))))
    p = probe.select(*keys, "_id", point.alias("_x"), F.struct(*columns).alias("_p")).select(
        *keys, F.col("_x.t").alias("_t"), F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_tie"), "_id",
        F.when((F.col("_x.d") == 0) | F.col(f"_p.{before_at}").isNull(), F.col("_p")).alias("_p"), F.col("_x.d").alias("_d"))
    b = build.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_k"), tie_id.alias("_tie"),
                     F.struct(F.struct(F.col(time).alias("t"), (-tie_id).alias("n")).alias("r"), *payload).alias("_b"))
    line = p.unionByName(b, allowMissingColumns=True)
    # among equal start times the backward match is the least tie: a first-of-time value
    found = scan(line, keys, ["_t", "_k", "_tie", "_d"], block_of("_t", width),
                 _back=RunMax(F.col("_b")), _fwd=NextSeen(F.col("_b")))
    both = found.filter("_id is not null").groupBy("_id").agg(
        F.any_value("_p", F.lit(True)).alias("_p"),
        F.any_value(F.when(F.col("_d") == 0, F.col("_back")), F.lit(True)).alias("_back"),
        F.any_value(F.when(F.col("_d") == 2, F.col("_fwd")), F.lit(True)).alias("_fwd"))
    return both.select("_p.*", *[F.col("_back")[c].alias(f"prev_{c}") for c in payload],
                       *[F.col("_fwd")[c].alias(f"next_{c}") for c in payload])
