"""Speech without a trace: uncovered stretches of turns, their context and their totals."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.intervals import overlap_join, subtract


def find_gaps(turns: DataFrame, segments: DataFrame, keys: Sequence[str], width: int, min_gap) -> DataFrame:
    """Parts of turns, at least ``min_gap`` long, that no segment covers."""
    return (subtract(turns, segments, keys, width, min_gap)
            .withColumn("duration", F.col("end") - F.col("start")))


def tally(gaps: DataFrame, keys: Sequence[str], thresholds: dict[str, int], story_end: str | None = None) -> DataFrame:
    """Count and total length of gaps per threshold, whole session and before ``story_end``."""
    inside = F.lit(True) if story_end is None else (F.col(story_end).isNull() | (F.col("start") < F.col(story_end)))
    aggs = []
    for name, least in thresholds.items():
        keep = F.col("duration") >= least
        aggs += [F.count_if(keep).alias(f"whole_n_{name}"),
                 F.coalesce(F.sum(F.when(keep, F.col("duration"))), F.lit(0)).alias(f"whole_len_{name}"),
                 F.count_if(keep & inside).alias(f"story_n_{name}"),
                 F.coalesce(F.sum(F.when(keep & inside, F.col("duration"))), F.lit(0)).alias(f"story_len_{name}")]
    return gaps.groupBy(*keys).agg(*aggs)


def recovered_words(gaps: DataFrame, heard: DataFrame, keys: Sequence[str], gap: Sequence[str], width: int) -> DataFrame:
    """Words whose midpoint lies in a gap, one row per (gap, word).

    The midpoint is doubled to stay an integer; points are intervals of length zero.
    """
    points = heard.withColumn("r_start", F.col("start") + F.col("end")).withColumn("r_end", F.col("r_start"))
    spans = gaps.select(*keys, *gap, (F.col("start") * 2).alias("start"), (F.col("end") * 2).alias("end"))
    inside = overlap_join(spans, points.select(*keys, "r_start", "r_end", F.col("word_id"), F.col("word")), keys,
                          2 * width, closed=True)
    return inside.select(*keys, *gap, "word_id", "word", F.col("r_start").alias("mid2"))


def recovery_yield(gaps: DataFrame, recovered: DataFrame, keys: Sequence[str], gap: Sequence[str]) -> DataFrame:
    """Per session: gaps probed and gaps that gave at least one word."""
    with_words = recovered.select(*keys, *gap).distinct().withColumn("_hit", F.lit(1))
    return (gaps.select(*keys, *gap).join(with_words, [*keys, *gap], "left")
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("probed"), F.count("_hit").alias("with_words")))
