"""Runs of equal values and gaps-and-islands over ordered rows."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.scans import BLOCK, block_of


def number_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column,
                starts: Callable[[Column, Column], Column] = lambda prev, row: ~prev.eqNullSafe(row),
                name: str = "run", prev_name: str | None = None) -> DataFrame:
    """Number the runs of rows: ``starts(prev, row)`` tells whether a row begins a new one.

    Starts are counted inside each block; a block's first row is settled against the last row of
    the block before, on one summary row per block. ``prev_name`` keeps the previous row's value.
    """
    keys, order = list(keys), list(order)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    local = df.withColumn(BLOCK, block).withColumn("_v", F.struct(value.alias("x")))
    local = local.withColumn("_lag", F.lag("_v").over(inside))
    begins = F.when(F.col("_lag").isNull(), 0).when(starts(F.col("_lag.x"), F.col("_v.x")), 1).otherwise(0)
    local = local.withColumn("_new", begins).withColumn(
        "_n", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct(*order)
    summary = local.groupBy(*keys, BLOCK).agg(
        F.min_by("_v", rank).alias("_fst"), F.max_by("_v", rank).alias("_lst"), F.sum("_new").alias("_tot"))
    summary = summary.withColumn("_before", F.lag("_lst").over(across))
    opens = F.when(F.col("_before").isNull(), 1).when(starts(F.col("_before.x"), F.col("_fst.x")), 1).otherwise(0)
    summary = summary.withColumn("_open", opens).withColumn(
        "_base", F.sum(F.col("_open") + F.col("_tot")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_tot"))
    joined = local.join(summary.select(*keys, BLOCK, "_before", "_base"), [*keys, BLOCK])
    extra = [F.coalesce("_lag", "_before")["x"].alias(prev_name)] if prev_name else []
    return joined.select(*df.columns, (F.col("_base") + F.col("_n")).alias(name), *extra)


def utterances(words: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Consecutive same-speaker words folded into one row; words without a speaker stay alone.

    Words of a run are joined per block first, so a long run is put together from parts.
    """
    runs = number_runs(words, keys, order, block, F.col("speaker_label"),
                       starts=lambda prev, row: prev.isNull() | row.isNull() | (prev != row))
    parts = runs.withColumn(BLOCK, block).groupBy(*keys, "run", BLOCK).agg(
        F.max("speaker_label").alias("_label"), F.min("start").alias("_start"),
        F.max_by("end", F.struct(*order)).alias("_end"), F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.struct(*order, F.btrim("word").alias("t")))).alias("_w"))
    parts = parts.withColumn("_w", F.array_join(F.transform("_w", lambda s: s["t"]), " "))
    return parts.groupBy(*keys, "run").agg(
        F.max("_label").alias("speaker_label"), F.min("_start").alias("start"),
        F.max_by("_end", BLOCK).alias("end"), F.sum("_n").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(BLOCK, "_w"))), lambda s: s["_w"]), " ").alias("text"))


def zones(candidates: DataFrame, keys: Sequence[str], max_gap: int, width: int) -> DataFrame:
    """Number groups of candidate positions at most ``max_gap`` apart (zone is 1-based)."""
    return number_runs(candidates, keys, ["pos"], block_of("pos", width), F.col("pos"),
                       starts=lambda prev, row: row - prev > max_gap, name="zone")


def runs_in_segment(words: Column, value: Callable[[Column], Column], min_length: int) -> Column:
    """Runs of an equal non-null value inside one segment (a segment is one source row).

    ``words`` is the segment's array of (word_index, word, start, end, ...) in order. Runs are found in
    the row itself, so words are neither moved nor sorted and a task holds one segment at a time.
    """
    def among(a: Column) -> Column:
        def edge(step: int) -> Column:
            return F.array_compact(F.transform(a, lambda x, i: F.when(x["v"].isNotNull() & ~x["v"].eqNullSafe(F.get(a, i + step)["v"]), i)))

        def run(span: Column) -> Column:
            first, last = span["first"], span["last"]
            head, inside = F.get(a, first)["w"], F.slice(a, first + 1, last - first + 1)
            return F.struct((last - first + 1).cast("long").alias("length"), head["word_index"].alias("word_index"),
                            F.array_min(F.transform(inside, lambda x: x["w"]["start"])).alias("start"),
                            F.get(a, last)["w"]["end"].alias("end"), head["word"].alias("first_word"))

        spans = F.zip_with(edge(-1), edge(1), lambda first, last: F.struct(first.alias("first"), last.alias("last")))
        return F.transform(F.filter(spans, lambda s: s["last"] - s["first"] >= min_length - 1), run)

    valued = F.transform(words, lambda w: F.struct(w.alias("w"), value(w).alias("v")))
    return F.get(F.transform(F.array(valued), among), 0)  # bound once, not once per word
