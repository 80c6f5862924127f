"""Interval joins, islands and complements (half-open intervals, any numeric time unit)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.runs import number_runs
from parley.operators.scans import block_of
from parley.operators.skew import keyed_lookup
from parley.session import staged


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / F.lit(width)), F.floor(end / F.lit(width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int,
                 ls: str = "start", le: str = "end", rs: str = "r_start", re: str = "r_end",
                 closed: bool = False) -> DataFrame:
    """All pairs of the same key whose intervals overlap (touch, when ``closed``).

    Both sides are cut into time buckets and equi-joined on (key, bucket); a pair is kept only in
    the bucket holding the later of the two starts, so no ``distinct`` follows. ``width`` should
    be near the p99 interval length. Skewed buckets are left to AQE's skew join.
    """
    a = left.filter(F.col(le) >= F.col(ls)).withColumn("_b", F.explode(_buckets(F.col(ls), F.col(le), width)))
    b = right.filter(F.col(re) >= F.col(rs)).withColumn("_b", F.explode(_buckets(F.col(rs), F.col(re), width)))
    meets = ((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le))) if closed else \
        ((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
    here = F.col("_b") == F.floor(F.greatest(F.col(ls), F.col(rs)) / F.lit(width))
    return a.join(b, [*keys, "_b"]).filter(meets & here).drop("_b")


def overlap_length(ls: str = "start", le: str = "end", rs: str = "r_start", re: str = "r_end") -> Column:
    return F.least(le, re) - F.greatest(ls, rs)


def merge_intervals(df: DataFrame, keys: Sequence[str], width: int,
                    start: str = "start", end: str = "end") -> DataFrame:
    """Sorted, non-overlapping spans; touching spans merge and empty ones are dropped.

    Intervals are cut at the borders of ``width``-long blocks and merged inside each block; what
    is left is to join neighbouring spans that touch. ``prev_end`` is the end of the span before
    (null for a key's first), so the hole in front of each span comes along.
    """
    w = F.lit(width)
    cut = (df.filter(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
           .withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / w), F.floor((F.col("_e") - 1) / w))))
           .select(*keys, "_b", F.greatest(F.col("_s"), F.col("_b") * w).alias("_s"),
                   F.least(F.col("_e"), (F.col("_b") + 1) * w).alias("_e")))
    inside = Window.partitionBy(*keys, "_b").orderBy("_s", "_e")
    reach = F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    local = (cut.withColumn("_new", F.when(F.col("_s") <= reach, 0).otherwise(1))
             .withColumn("_i", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*keys, "_b", "_i").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")))
    runs = number_runs(staged(local.drop("_b", "_i")), keys, ["_s"], block_of("_s", width * 64), F.struct("_s", "_e"),
                       starts=lambda prev, row: row["_s"] > prev["_e"], prev_name="_p")
    return (runs.groupBy(*keys, "run").agg(F.min("_s").alias(start), F.max("_e").alias(end),
                                           F.min_by("_p", "_s").alias("_p"))
            .select(*keys, start, end, F.col("_p._e").alias("prev_end")))


def subtract(targets: DataFrame, cover: DataFrame, keys: Sequence[str], width: int, min_length=0) -> DataFrame:
    """Parts of ``targets`` (start, end, payload), at least ``min_length`` long, outside the union of ``cover``.

    Holes between covers meet the targets in one overlap join; what is too short for a piece stays out of it. What sticks out before a key's
    first cover or after its last needs only those two bounds.
    """
    t = targets.filter((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= F.lit(min_length)))
    payload = [c for c in targets.columns if c not in ("start", "end")]
    holes = (merge_intervals(cover, keys, width).filter("prev_end is not null")
             .select(*keys, F.col("prev_end").alias("r_start"), F.col("start").alias("r_end"))
             .filter(F.col("r_end") - F.col("r_start") >= F.lit(min_length)))
    inner = overlap_join(t, holes, keys, width).select(
        *payload, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
    bounds = cover.filter("end > start").groupBy(*keys).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    edged = keyed_lookup(t, bounds, keys, ["start", "end"], "left")
    piece = F.explode(F.when(F.col("_lo").isNull(), F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))))
                      .otherwise(F.array(F.struct(F.col("start").alias("s"), F.least("end", "_lo").alias("e")),
                                         F.struct(F.greatest("start", "_hi").alias("s"), F.col("end").alias("e")))))
    outer = edged.select(*payload, piece.alias("_x")).select(*payload, F.col("_x.s").alias("start"), F.col("_x.e").alias("end"))
    return inner.unionByName(outer).filter((F.col("end") > F.col("start"))
                                           & (F.col("end") - F.col("start") >= F.lit(min_length)))
