"""Who speaks when: word speakers, coverage, dominant speakers and unintelligible gaps."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import gap_id
from parley.operators.asof import bracket
from parley.operators.intervals import overlap_join, overlap_length


def _turn_side(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    return turns.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "speaker")


def speaker_overlaps(words: DataFrame, turns: DataFrame, keys: Sequence[str], ids: Sequence[str],
                     width: int) -> DataFrame:
    """(keys, ids, speaker, overlap, first_turn): seconds each speaker shares with each word."""
    spans = words.filter("end > start").select(*keys, *ids, "start", "end")
    pairs = overlap_join(spans, _turn_side(turns, keys), keys, width)
    return (pairs.groupBy(*keys, *ids, "speaker")
            .agg(F.sum(overlap_length()).alias("overlap"), F.min("r_start").alias("first_turn")))


def word_speakers(words: DataFrame, turns: DataFrame, keys: Sequence[str], ids: Sequence[str], width: int) -> DataFrame:
    """Best-overlapping speaker of each word and the share of the word it covers.

    Ties go to the speaker whose first overlapping turn is earliest; empty words and words nobody
    covers get no label and coverage 0. Pairs and words meet in one shuffle on the word's identity.
    """
    best = ["_ov", "_first", "speaker"]
    pairs = overlap_join(words.filter("end > start").select(*keys, *ids, "start", "end"), _turn_side(turns, keys), keys, width)
    hits = pairs.select(*keys, *ids, "speaker", overlap_length().alias("_ov"), F.col("r_start").alias("_first"),
                        F.lit(None).cast("double").alias("_dur"))
    own = words.select(*keys, *ids, (F.col("end") - F.col("start")).cast("double").alias("_dur"))
    together = hits.unionByName(own, allowMissingColumns=True).repartition(*keys, *ids)
    per_speaker = together.groupBy(*keys, *ids, "speaker").agg(
        F.sum("_ov").alias("_ov"), F.min("_first").alias("_first"), F.max("_dur").alias("_dur"))
    rank = F.when(F.col("speaker").isNotNull(), F.struct(F.col("_ov"), -F.col("_first")))
    return (per_speaker.groupBy(*keys, *ids)
            .agg(F.max_by(F.struct(*best), rank).alias("_b"), F.max("_dur").alias("_dur"))
            .select(*keys, *ids, F.col("_b.speaker").alias("speaker_label"),
                    F.when(F.col("_b").isNull(), F.lit(0.0))
                     .otherwise(F.least(F.col("_b._ov") / F.col("_dur"), F.lit(1.0))).alias("coverage")))


def coverage_fractions(words: DataFrame, turns: DataFrame, keys: Sequence[str], ids: Sequence[str], width: int) -> DataFrame:
    """Each speaker's share of each word, and the total share capped at 1."""
    per = speaker_overlaps(words, turns, keys, ids, width)
    lengths = words.select(*keys, *ids, (F.col("end") - F.col("start")).alias("_d"))
    total = per.groupBy(*keys, *ids).agg(F.sum("overlap").alias("_all"))
    shares = per.join(lengths.join(total, [*keys, *ids]), [*keys, *ids])
    return shares.select(*keys, *ids, "speaker", (F.col("overlap") / F.col("_d")).alias("fraction"),
                         F.least(F.col("_all") / F.col("_d"), F.lit(1.0)).alias("total"))


def total_coverage(spans: DataFrame, cover: DataFrame, keys: Sequence[str], ids: Sequence[str], width: int,
                   name: str = "coverage") -> DataFrame:
    """Share of each span inside ``cover`` rows (double counted where those overlap), capped at 1."""
    own = spans.select(*keys, *ids, (F.col("end") - F.col("start")).alias("_dur"), F.lit(0).cast("double").alias("_ov"))
    pairs = overlap_join(spans.filter("end > start").select(*keys, *ids, "start", "end"),
                         cover.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end")), keys, width)
    hits = pairs.select(*keys, *ids, F.lit(None).cast("bigint").alias("_dur"), overlap_length().cast("double").alias("_ov"))
    return (hits.unionByName(own).groupBy(*keys, *ids).agg(F.sum("_ov").alias("_ov"), F.max("_dur").alias("_dur"))
            .select(*keys, *ids, F.when(F.col("_dur") > 0, F.least(
                F.col("_ov") / F.nullif(F.col("_dur"), F.lit(0)), F.lit(1.0))).otherwise(F.lit(0.0)).alias(name)))


def turn_word_coverage(turns: DataFrame, words: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Turns with the share of their time that words cover."""
    named = turns.withColumn("_s", F.col("start")).withColumn("_e", F.col("end"))
    covered = total_coverage(named, words, keys, ["_s", "_e", "speaker"], width)
    return covered.withColumnRenamed("_s", "start").withColumnRenamed("_e", "end")


def dominant_speakers(words: DataFrame, keys: Sequence[str] = ("session_id", "seg_pos"), order: str = "word_index") -> DataFrame:
    """Label with the most words per segment; ties go to the label heard first; none gives null."""
    counts = words.groupBy(*keys, "speaker_label").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    rank = F.when(F.col("speaker_label").isNotNull(), F.struct(F.col("_n"), -F.col("_first")))
    return counts.groupBy(*keys).agg(F.max_by("speaker_label", rank).alias("speaker_label"))


def unintelligible_gaps(turns: DataFrame, words: DataFrame, segments: DataFrame, keys: Sequence[str], tie: str,
                        width: int, block: int, max_coverage: float = 0.3, per_second: float = 1.0) -> DataFrame:
    """Turns words hardly cover whose speaker differs from both neighbouring segments' speakers."""
    quiet = turn_word_coverage(turns.filter("end > start"), words, keys, width).filter(F.col("coverage") < max_coverage)
    near = bracket(quiet, segments, keys, ["speaker_label"], tie, block)
    odd = near.filter((F.col("speaker") != F.col("prev_speaker_label")) & (F.col("speaker") != F.col("next_speaker_label")))
    return odd.select(*keys, gap_id(F.col("start") / F.lit(per_second)).alias("seg_id"), "start", "end",
                      F.lit("[unintelligible]").alias("text"), F.col("speaker").alias("speaker_label"),
                      F.lit("diarization_gap").alias("source"))


def inject_gaps(segments: DataFrame, gaps: DataFrame) -> DataFrame:
    """Segments with gap rows added; ``sort_rank`` orders equal starts, own rows first."""
    own = segments.withColumn("sort_rank", F.lit(0))
    return own.unionByName(gaps.withColumn("sort_rank", F.lit(1)), allowMissingColumns=True)


def speaker_group_numbers(speakers: DataFrame, keys: Sequence[str], label: str, identity: str) -> DataFrame:
    """Display number of each speaker: the least number among labels of one identity."""
    from parley.functions.text import speaker_number
    numbered = speakers.withColumn("_n", speaker_number(label)).withColumn("_g", F.coalesce(identity, label))
    least = numbered.groupBy(*keys, "_g").agg(F.min("_n").alias("number"))
    return numbered.join(least, [*keys, "_g"]).select(*keys, label, identity, "number", (F.col("number") % 5).alias("color"))


def transcript_line() -> Column:
    """'speaker: text' of an utterance."""
    return F.concat_ws(": ", F.coalesce("speaker_label", F.lit("UNKNOWN")), F.col("text"))
