"""What still has to run, what is a repeat, and keeping keyed tables up to date."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.scans import BLOCK, block_of, running_number
from parley.session import staged


def segment_fingerprints(words: DataFrame) -> DataFrame:
    """sha-256 of each segment's words, one per line."""
    ordered = F.array_sort(F.collect_list(F.struct("word_index", "word")))
    return words.groupBy("session_id", "seg_pos").agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["word"]), "\n"), 256).alias("fp"))


def session_fingerprints(words: DataFrame, block: int) -> DataFrame:
    """Fingerprint of a recording: the hash over its blocks' hashes over its segments' hashes.

    Any edit changes it, as a hash of the joined words would, but no task holds a whole recording.
    """
    def fold(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, "fp")))
        return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["fp"]), "\n"), 256).alias("fp"))
    segs = segment_fingerprints(words).withColumn(BLOCK, block_of("seg_pos", block))
    return fold(fold(segs, ["session_id", BLOCK], "seg_pos"), ["session_id"], BLOCK)


def config_stamp(*parts: str) -> Column:
    """Short hash of a stage's settings."""
    return F.substring(F.sha2(F.lit("|".join(parts)), 256), 1, 16)


def stale(inputs: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Sessions whose (stage, input, config) is not among the finished ones; never-run ones included."""
    if force:
        return inputs
    return inputs.join(done.select("session_id", "stage", "fp", "config").distinct(), ["session_id", "stage", "fp", "config"], "left_anti")


def classify_intake(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """new, duplicate or collision for each arrival, against known and earlier admitted recordings.

    Columns: uuid (may be null), session_id (from the recording's time), md5, ordinal for arrivals.
    The same uuid, or the same time and content, is a duplicate; the same time with other content a
    collision. A refused arrival is no recording, so it makes no later one a repeat. Arrivals are
    settled in rounds: the first open one of its uuid and of its time is admitted, and closes both.
    """
    old_uuid = known.filter("uuid is not null").select("uuid").distinct()
    old_time = known.select("session_id").distinct()
    columns = ["ordinal", "uuid", "session_id", "md5"]
    waiting = staged(arrivals.select(*columns).join(old_uuid, "uuid", "left_anti").join(old_time, "session_id", "left_anti").select(*columns))
    admitted = waiting.limit(0)
    while waiting.limit(1).count():
        by_uuid = waiting.filter("uuid is not null").groupBy("uuid").agg(F.min("ordinal").alias("_fu"))
        by_time = waiting.groupBy("session_id").agg(F.min("ordinal").alias("_ft"))
        met = waiting.join(by_uuid, "uuid", "left").join(by_time, "session_id")
        took = staged(met.filter((F.col("ordinal") == F.col("_ft")) & (F.col("uuid").isNull() | (F.col("ordinal") == F.col("_fu")))).select(*columns))
        admitted = admitted.unionByName(took)
        waiting = staged(waiting.join(took.select("uuid").filter("uuid is not null"), "uuid", "left_anti")
                         .join(took.select("session_id"), "session_id", "left_anti").select(*columns))
    held = known.select("uuid", "session_id", "md5", F.lit(None).cast("long").alias("_at")).unionByName(
        admitted.select("uuid", "session_id", "md5", F.col("ordinal").cast("long").alias("_at")))
    uuids = held.filter("uuid is not null").groupBy("uuid").agg(F.min(F.coalesce("_at", F.lit(-1))).alias("_u"))
    same = held.groupBy("session_id", "md5").agg(F.min(F.coalesce("_at", F.lit(-1))).alias("_s"))
    mine = admitted.select("ordinal", F.lit(True).alias("_new"))
    j = (arrivals.join(mine, "ordinal", "left").join(uuids, "uuid", "left").join(same, ["session_id", "md5"], "left"))
    o = F.col("ordinal")
    verdict = (F.when(F.col("_new"), "new").when((F.col("_u") < o) | (F.col("_s") < o), "duplicate").otherwise("collision"))
    return j.select(*arrivals.columns, verdict.alias("verdict"))


def stage_health(processing: DataFrame) -> DataFrame:
    """Runs, failures and time per stage."""
    return processing.groupBy("stage").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("status") == "error").alias("n_failed"),
                                           F.round(F.sum("duration_seconds"), 2).alias("seconds"))


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows replaced or added by key."""
    return table.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def remove(table: DataFrame, keys_gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(keys_gone.select(*keys).distinct(), list(keys), "left_anti")


STATUSES = ("not_started", "in_progress", "done")


def set_status(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Validation status and note of sessions changed one field at a time; unknown statuses are an error."""
    ok = F.assert_true(F.col("_s").isNull() | F.col("_s").isin(*STATUSES), F.lit("unknown validation status")).isNull()
    c = changes.select("session_id", F.col("validation_status").alias("_s"), F.col("note").alias("_n")).filter(ok)
    return meta.join(c, "session_id", "full_outer").select(
        "session_id", F.coalesce("_n", "note").alias("note"), F.coalesce("_s", "validation_status", F.lit("not_started")).alias("validation_status"))


def session_inventory(sessions: DataFrame, artifacts: dict[str, DataFrame], notes: DataFrame, processing: DataFrame,
                      labels: DataFrame, fixture: str = "00000000-000000") -> DataFrame:
    """One row per valid session: artifact flags, note count, failed stages and story label."""
    valid = sessions.filter(F.col("session_id").rlike(r"^\d{8}-\d{6}$") & (F.col("session_id") != fixture))
    out = valid
    for name, df in artifacts.items():
        out = out.join(df.select("session_id").distinct().withColumn(f"has_{name}", F.lit(True)), "session_id", "left")
        out = out.withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    n = notes.groupBy("session_id").agg(F.count(F.lit(1)).alias("note_count"))
    failed = (processing.filter("status = 'error'").groupBy("session_id", "stage").agg(F.lit(1).alias("_x"))
              .groupBy("session_id").agg(F.array_sort(F.collect_list("stage")).alias("failed_stages")))
    out = out.join(n, "session_id", "left").join(failed, "session_id", "left").join(labels.select("session_id", F.col("label").alias("stories")), "session_id", "left")
    return out.withColumn("note_count", F.coalesce("note_count", F.lit(0))).withColumn(
        "failed_stages", F.coalesce("failed_stages", F.array().cast("array<string>")))


def sort_sessions(inventory: DataFrame, by: str = "date", descending: bool = True) -> DataFrame:
    """Session list order: date, length (unknown shortest), validation or notes; newest first within."""
    key = {"date": F.col("session_id"), "length": F.coalesce("duration_seconds", F.lit(-1.0)),
           "validation": F.when(F.col("validation_status") == "not_started", 0).when(F.col("validation_status") == "in_progress", 1).otherwise(2),
           "notes": F.col("note_count")}[by]
    return inventory.orderBy(key.desc() if descending else key.asc(), F.desc("session_id"))


def assemble_benchmark(parts: DataFrame, cells: Sequence[str], deny: Sequence[str]) -> DataFrame:
    """Stories of all part files in cell order, numbered s001..., with the rules each one breaks.

    A story with missing keys is reported and has its number too.

    ``parts``: cell, pos, bucket, difficulty, world_gold, world_aliases, lines, tell_note.
    """
    text = F.lower(F.array_join("lines", " \n "))
    gold = F.coalesce("world_gold", F.lit(""))
    made = F.col("bucket") == "made_up"
    named = F.filter(F.array(*[F.lit(d) for d in deny]).cast("array<string>"), lambda d: F.contains(text, d))
    missing = F.col("bucket").isNull() | F.col("difficulty").isNull() | F.col("world_gold").isNull() | F.col("world_aliases").isNull() \
        | F.col("lines").isNull() | F.col("tell_note").isNull()
    errors = F.when(missing, F.array(F.lit("missing keys"))).otherwise(F.array_compact(F.array(
        F.when(~F.col("bucket").isin("canon", "hybrid", "made_up"), "bad bucket"),
        F.when(~F.col("difficulty").isin("obvious", "medium", "subtle"), "bad difficulty"), F.when(F.size("lines") < 6, "too few lines"),
        F.when(made & ((gold != "") | (F.size("world_aliases") > 0)), "made_up names a world"), F.when(~made & (gold == ""), "no world"))))
    warnings = F.array_compact(F.array(F.when(made & (F.size(named) > 0), "franchise named"),
                                       F.when(~made & F.col("difficulty").isin("medium", "subtle") & (gold != "") & F.contains(text, F.lower(gold)), "world named aloud")))
    order = F.array_position(F.array(*[F.lit(c) for c in cells]), F.col("cell"))
    # the number of a story is its place in its cell after the stories of the cells before
    sized = parts.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", order)
    offsets = sized.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = running_number(parts, ["cell"], ["pos"], block_of("pos", 65536), "_i")
    out = placed.join(offsets.select("cell", "_off"), "cell").withColumn("id", F.format_string("s%03d", F.col("_off") + F.col("_i")))
    return out.withColumn("errors", errors).withColumn("warnings", warnings).drop("_off", "_i")


def key_staleness(keys: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, state): 'unstamped' keys carry no fingerprint, 'stale' ones another than the transcript has now, else 'current'.

    ``keys``: session_id, stamp; ``current``: session_id, fp. A key whose recording is gone is stale.
    """
    met = keys.join(current.select("session_id", "fp"), "session_id", "left")
    state = F.when(F.col("stamp").isNull(), "unstamped").when(F.col("stamp").eqNullSafe(F.col("fp")), "current").otherwise("stale")
    return met.select("session_id", state.alias("state"))


def benchmark_counts(stories: DataFrame, expected: DataFrame) -> DataFrame:
    """(cell, n, expected, ok): stories per cell against the number each should have; either side may lack a cell."""
    n = stories.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    both = n.join(expected.select("cell", "expected"), "cell", "full_outer").na.fill(0, ["n", "expected"])
    return both.withColumn("ok", F.col("n") == F.col("expected"))
