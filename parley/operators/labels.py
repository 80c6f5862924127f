"""Human failure codes: normalising, merging, toggling, folding and counting."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.intervals import overlap_join
from parley.operators.skew import keyed_lookup

NO_FAILURE, ORPHANED = "NotA", "M7"


def normalise(labels: DataFrame) -> DataFrame:
    """Labels with ``codes`` arrays; an old scalar ``code`` becomes a one-element array."""
    return labels.withColumn("codes", F.coalesce("codes", F.when(F.col("code").isNotNull(), F.array("code")))).drop("code")


def other_failures(codes: Column | str = "codes") -> Column:
    """Codes that name another failure than a drifted timestamp."""
    return F.array_except(codes, F.array(F.lit(NO_FAILURE), F.lit(ORPHANED)))


def merge_code(labels: DataFrame, segments: DataFrame, code: str, keys: Sequence[str] = ("session_id", "seg_id")) -> DataFrame:
    """Labels with ``code`` on the given segments and what happened to each: new, replaced, added, already."""
    hit = segments.select(*keys).distinct().withColumn("_hit", F.lit(True))
    both = labels.join(hit, list(keys), "full_outer")
    had = F.coalesce("codes", F.array().cast("array<string>"))
    only_none = (F.size(had) == 1) & F.array_contains(had, NO_FAILURE)
    change = (F.when(F.col("_hit").isNull(), None).when(F.col("codes").isNull(), "new")
              .when(F.array_contains(had, code), "already").when(only_none, "replaced").otherwise("added"))
    new = F.when(F.col("_hit").isNull() | F.array_contains(had, code), had).otherwise(
        F.concat(F.array_remove(had, NO_FAILURE), F.array(F.lit(code))))
    return both.withColumn("change", change).withColumn("codes", new).drop("_hit")


def toggled(codes: Column, code: Column) -> Column:
    """Codes after pressing one: 'no failure' stands alone, a code pressed again goes away."""
    had = F.coalesce(codes, F.array().cast("array<string>"))
    rest = F.array_remove(had, NO_FAILURE)
    return (F.when((code == NO_FAILURE) & F.array_contains(had, NO_FAILURE), F.array().cast("array<string>"))
            .when(code == NO_FAILURE, F.array(code))
            .when(F.array_contains(rest, code), F.array_remove(rest, code)).otherwise(F.concat(rest, F.array(code))))


def toggle(labels: DataFrame, presses: DataFrame, keys: Sequence[str] = ("session_id", "seg_id")) -> DataFrame:
    """Labels after one press per segment; a segment left without codes loses its row."""
    both = labels.join(presses.withColumnRenamed("code", "_press"), list(keys), "full_outer")
    new = F.when(F.col("_press").isNull(), F.col("codes")).otherwise(toggled(F.col("codes"), F.col("_press")))
    return both.withColumn("codes", new).drop("_press").filter(F.size("codes") > 0)


def fold_loops(segments: DataFrame, labels: DataFrame, stretches: DataFrame, width: int, code: str = "M10") -> DataFrame:
    """Labels with each filler stretch counted once.

    In a stretch (session_id, lo, hi, filler) the first line equal to the filler carries ``code``
    alone and the labels of the others go. Labels and segments share ``seg_pos``.
    """
    points = segments.withColumn("_p", F.col("seg_pos").cast("long")).withColumn("_q", F.col("_p"))
    inside = overlap_join(points, stretches, ["session_id"], width, "_p", "_q", "lo", "hi", closed=True)
    folded = inside.filter(F.btrim("text") == F.col("filler"))
    first = folded.groupBy("session_id", "lo", "hi").agg(F.min("seg_pos").alias("seg_pos"))
    heads = first.select("session_id", "seg_pos").distinct()
    rest = folded.select("session_id", "seg_pos").distinct()
    kept = labels.join(rest, ["session_id", "seg_pos"], "left_anti")
    return kept.select("session_id", "seg_pos", "codes").unionByName(heads.withColumn("codes", F.array(F.lit(code))))


def failure_pivot(labels: DataFrame) -> DataFrame:
    """(mode, session_id, n): labelled segments per code and session; session_id null holds the code's total.

    The cells are rows, so any number of sessions fits.
    """
    rows = labels.select("session_id", F.explode(F.array_distinct("codes")).alias("mode"))
    cells = rows.groupBy("mode", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.unionByName(cells.groupBy("mode").agg(F.sum("n").alias("n")).withColumn("session_id", F.lit(None).cast("string")))


def multi_coded(labels: DataFrame) -> DataFrame:
    return labels.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_labels"),
                                            F.count_if(F.size(F.array_distinct("codes")) > 1).alias("n_multi"))


def case_breakout(words: DataFrame, labels: DataFrame, variants: DataFrame, code: str = "M9") -> DataFrame:
    """Uses of each name case's variants (case, form) inside segments coded ``code``, per session."""
    coded = labels.filter(F.exists("codes", lambda c: c.startswith(code))).select("session_id", "seg_pos").distinct()
    inside = words.join(coded, ["session_id", "seg_pos"], "left_semi")
    hits = keyed_lookup(inside, variants.select("case", F.col("form").alias("c")).distinct(), ["c"], ["session_id", "seg_pos", "word_index"])
    return hits.groupBy("session_id", "case").agg(F.count(F.lit(1)).alias("n"))
