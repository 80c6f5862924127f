"""Loudness frames and drifted timestamps."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import is_filler
from parley.operators.intervals import overlap_join
from parley.operators.scans import RunSum, block_of, scan
from parley.operators.skew import keyed_lookup


def loudness_frames(samples: DataFrame, frame: Column) -> DataFrame:
    """dBFS per frame from samples ``x``: root mean square, floored at 1e-10."""
    power = samples.groupBy("session_id", frame.cast("long").alias("frame_idx")).agg(F.avg(F.col("x") * F.col("x")).alias("_p"))
    return power.select("session_id", "frame_idx", (20 * F.log10(F.greatest(F.sqrt("_p"), F.lit(1e-10)))).alias("db"))


def percentile_of(df: DataFrame, keys: Sequence[str], value: str, p: float, block: Column) -> DataFrame:
    """Exact interpolated percentile per key, from value counts and a blocked cumulative sum.

    Spark's ``percentile`` keeps a key's values in one buffer; this holds no more than a block.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = scan(counts, keys, [value], block, _cum=RunSum(F.col("_c")))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = (F.col("_n") - 1) * F.lit(p)
    ranked = keyed_lookup(cum, total, keys, [value]).withColumn("_lo", F.floor(at)).withColumn("_w", at - F.floor(at))
    return (ranked.groupBy(*keys).agg(F.min(F.when(F.col("_cum") > F.col("_lo"), F.col(value))).alias("_a"),
                                      F.min(F.when(F.col("_cum") > F.col("_lo") + 1, F.col(value))).alias("_b"), F.max("_w").alias("_w"))
            .select(*keys, (F.col("_a") + F.col("_w") * (F.coalesce("_b", "_a") - F.col("_a"))).alias("percentile")))


def noise_floor(frames: DataFrame, p: float = 0.2, margin: float = 12.0) -> DataFrame:
    """(session_id, floor, threshold): quiet level of a recording and the level that counts as loud."""
    f = percentile_of(frames, ["session_id"], "db", p, F.floor(F.col("db") * 64))
    return f.select("session_id", F.col("percentile").alias("floor"), (F.col("percentile") + margin).alias("threshold"))


def window_loudness(spans: DataFrame, frames: DataFrame, ids: Sequence[str], frame_len: int, width: int, name: str = "loud_db") -> DataFrame:
    """Loudest frame touching each span (session_id, ids, start, end); frame numbers are truncated."""
    last = frames.groupBy("session_id").agg(F.max("frame_idx").alias("_last"))
    s = keyed_lookup(spans.select("session_id", *ids, "start", "end"), last, ["session_id"], list(ids))
    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(x, F.col("_last")))
    s = s.withColumn("_i0", clamp((F.col("start") / frame_len).cast("long")))
    s = s.withColumn("_i1", F.greatest(F.col("_i0"), clamp((F.col("end") / frame_len).cast("long"))))
    f = frames.select("session_id", F.col("frame_idx").alias("_f"), F.col("frame_idx").alias("_g"), "db")
    pairs = overlap_join(s, f, ["session_id"], width, "_i0", "_i1", "_f", "_g", closed=True)
    return pairs.groupBy("session_id", *ids).agg(F.max("db").alias(name))


def without_filler_loops(words: DataFrame, segments: DataFrame, stretches: DataFrame, width: int) -> DataFrame:
    """Words outside folded filler loops: lines of a stretch (session_id, lo, hi, filler) that are the filler alone go."""
    points = segments.withColumn("_p", F.col("seg_pos").cast("long")).withColumn("_q", F.col("_p"))
    inside = overlap_join(points, stretches, ["session_id"], width, "_p", "_q", "lo", "hi", closed=True)
    folded = inside.filter(F.btrim("text") == F.col("filler")).select("session_id", "seg_pos").distinct()
    return words.join(folded, ["session_id", "seg_pos"], "left_anti")


def classify_drift(words: DataFrame) -> DataFrame:
    """Category and score of each word from loud_db, near_db, threshold, total and other_codes."""
    loud = F.col("loud_db") >= F.col("threshold")
    quiet = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("threshold") - F.col("loud_db")) / 15.0))
    nobody = F.col("total") < 0.10
    near = F.col("near_db") >= F.col("threshold")
    coded = F.size("other_codes") > 0
    cat = (F.when(loud, "ok").when(nobody & near & coded, "drifted_coded").when(nobody & near, "drifted")
           .when(nobody, "isolated").otherwise("quiet_ambiguous"))
    score = (F.when(loud, 0.0).when(nobody & near, 0.6 + 0.4 * quiet).when(nobody, 0.4 + 0.2 * quiet).otherwise(0.3 + 0.2 * quiet))
    return words.withColumn("category", cat).withColumn("score", F.round(score, 3))


def drift_tally(words: DataFrame) -> DataFrame:
    """Words per session and category, segments by how many drifted words they hold."""
    cats = ["ok", "drifted", "drifted_coded", "isolated", "quiet_ambiguous"]
    per = words.groupBy("session_id").agg(*[F.count_if(F.col("category") == c).alias(c) for c in cats])
    seg = words.filter("category = 'drifted'").groupBy("session_id", "seg_pos").agg(F.count(F.lit(1)).alias("_n"))
    sev = seg.groupBy("session_id").agg(*[F.count_if(F.col("_n") == k).alias(f"segments_{k}") for k in (1, 2, 3)],
                                        F.count_if(F.col("_n") >= 4).alias("segments_4plus"))
    return per.join(sev, "session_id", "left").na.fill(0)


def check_list(words: DataFrame, n: int = 100) -> DataFrame:
    """Drifted words to listen to: fillers first, then by score, at most ``n``."""
    rows = words.filter("category = 'drifted'").withColumn("filler", is_filler("word"))
    return rows.orderBy(F.desc("filler"), F.desc("score"), "session_id", "seg_pos", "event_id").limit(n)


def gap_suggestion(gaps: DataFrame) -> DataFrame:
    """'M8' for gaps with nothing to hear (model sure of silence or no words), else 'speech'."""
    return gaps.withColumn("suggestion", F.when((F.col("no_speech_prob") >= 0.9) | (F.col("n_words") == 0), "M8").otherwise("speech"))


def gap_agreement(gaps: DataFrame) -> DataFrame:
    """Confusion of suggestion and human code on gaps coded exactly one of M8, NotA, M3."""
    clean = gaps.filter((F.size("codes") == 1) & F.element_at("codes", 1).isin("M8", "NotA", "M3"))
    return clean.groupBy(F.when(F.element_at("codes", 1) == "M8", "M8").otherwise("speech").alias("expected"), "suggestion").agg(
        F.count(F.lit(1)).alias("n"))
