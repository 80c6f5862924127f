"""Text put together for a reader: numbered windows, cast sentences and card lists."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def window_texts(windows: DataFrame, segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """One text per zone: its lines in order, signals beside them, a mark where lines are left out.

    A window holds at most 22 lines, so a zone's text is put together in one row.
    """
    lines = windows.join(segments.select("session_id", "seg_pos", "seg_id", F.btrim("text").alias("_t")), ["session_id", "seg_pos"])
    signals = candidates.select("session_id", F.col("pos").alias("seg_pos"), F.array_join(F.array_sort("signals"), ", ").alias("_s"))
    lines = lines.join(signals, ["session_id", "seg_pos"], "left")
    shown = F.concat(F.lit("["), "seg_id", F.lit('] "'), F.when(F.col("_t") == "", "[no text]").otherwise(F.col("_t")), F.lit('"'),
                     F.when(F.col("_s").isNotNull(), F.concat(F.lit("   (signals: "), "_s", F.lit(")"))).otherwise(""))
    per = lines.groupBy("session_id", "zone").agg(
        F.array_sort(F.collect_list(F.struct("seg_pos", shown.alias("t")))).alias("_l"),
        F.max(F.when(~F.col("after_elision"), F.col("seg_pos"))).alias("_a"), F.min(F.when(F.col("after_elision"), F.col("seg_pos"))).alias("_b"))
    head = F.transform(F.filter("_l", lambda s: F.col("_b").isNull() | (s["seg_pos"] < F.col("_b"))), lambda s: s["t"])
    tail = F.transform(F.filter("_l", lambda s: s["seg_pos"] >= F.col("_b")), lambda s: s["t"])
    mark = F.format_string("   ... [%d lines omitted] ...", F.col("_b") - F.col("_a") - 1)
    return per.select("session_id", "zone", F.array_join(F.when(F.col("_b").isNull(), head).otherwise(F.concat(head, F.array(mark), tail)), "\n").alias("text"))


def cast_sentences(cast: DataFrame) -> DataFrame:
    """One sentence per world naming its first six and next fourteen cast names."""
    from pyspark.sql import Window
    top = cast.withColumn("_i", F.row_number().over(Window.partitionBy("world").orderBy("cast_rank"))).filter("_i <= 20")
    per = top.groupBy("world").agg(F.array_sort(F.collect_list(F.struct("_i", "name"))).alias("_l"))
    names = F.transform("_l", lambda s: s["name"])
    rest = F.slice(names, 7, 14)
    return per.select("world", F.concat(
        F.lit("This is a bedtime story about the "), "world", F.lit(". Its characters include "), F.array_join(F.slice(names, 1, 6), ", "),
        F.when(F.size(rest) > 0, F.concat(F.lit(", and "), F.array_join(rest, ", "))).otherwise(""), F.lit(".")).alias("sentence"))


def card_lists(cards: DataFrame, surfaces: DataFrame, examples: DataFrame, scope: Sequence[str], cut: int = 130) -> DataFrame:
    """One text per card: number, spellings, uses and up to three example lines.

    ``surfaces``: scope, card_key, surface; ``examples``: scope, card_key, rank, line.
    """
    keys = [*scope, "card_key"]
    s = surfaces.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit('"'), "surface", F.lit('"')))), ", ").alias("_s"))
    e = examples.filter("rank <= 3").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("line", 1, cut).alias("t")))).alias("_e"))
    lines = F.transform(F.coalesce("_e", F.array().cast("array<struct<rank:int,t:string>>")), lambda x: F.concat(F.lit('    - "'), x["t"], F.lit('"')))
    head = F.concat(F.lit("["), F.col("card_id").cast("string"), F.lit("] spellings: "), "_s", F.lit("  ("), F.col("n").cast("string"), F.lit(" uses)"),
                    F.when(F.col("is_phrase"), " [multi-word]").otherwise(""))
    return cards.join(s, keys).join(e, keys, "left").select(*keys, F.array_join(F.concat(F.array(head), lines), "\n").alias("text"))
