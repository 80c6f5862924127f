"""Story boundaries: line facts, signals, zones, windows, assembly, consolidation and tagging."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.intervals import overlap_join
from parley.operators.runs import number_runs, zones
from parley.operators.scans import LastSeen, Next, Prev, RunMax, RunSum, block_of, running_number, scan
from parley.operators.skew import keyed_lookup
from parley.session import materialize

S = ["session_id"]
CONTEXT, MAX_WINDOW, HEAD, TAIL = 3, 22, 11, 9


def line_facts(segments: DataFrame, block: int) -> DataFrame:
    """Position facts of each line: pause before it, edges of the recording, repeated text."""
    body = F.lower(tx.strip("text"))
    seen = scan(segments, S, ["seg_pos"], block_of("seg_pos", block), _pe=Prev(F.col("end")), _pt=Prev(body), _nt=Next(body))
    dup = (body != "") & (F.coalesce(body == F.col("_pt"), F.lit(False)) | F.coalesce(body == F.col("_nt"), F.lit(False)))
    return (seen.withColumn("gap_before", F.col("start") - F.col("_pe")).withColumn("is_first", F.col("_pt").isNull())
            .withColumn("is_last", F.col("_nt").isNull()).withColumn("dup_run", dup).drop("_pe", "_pt", "_nt"))


def boundary_candidates(facts: DataFrame, min_gap: float, per_second: float = 1.0, cues: dict = tx.CUES) -> DataFrame:
    """(session_id, pos, signals): positions where a story may begin or end."""
    pause = F.col("gap_before") >= min_gap
    signals = F.array_compact(F.concat(
        F.array(F.when(F.col("is_first"), "sentinel:rec-start"), F.when(F.col("is_last"), "sentinel:rec-end")),
        F.transform(tx.cue_tags("text", cues), lambda k: F.concat(F.lit("cue:"), k)),
        F.array(F.when(pause, F.format_string("gap:%.1fs", F.col("gap_before") / F.lit(per_second))),
                F.when(F.col("is_gap"), "struct:unintelligible"), F.when(F.col("dup_run"), "struct:dup"))))
    return facts.select("session_id", F.col("seg_pos").alias("pos"), signals.alias("signals")).filter(F.size("signals") > 0)


def boundary_zones(candidates: DataFrame, block: int, max_gap: int = 3) -> DataFrame:
    """Zones of nearby candidates with their span and the union of their signals."""
    kinds = zones(candidates, S, max_gap, block).select("session_id", "zone", "pos", F.explode("signals").alias("signal"))
    return kinds.groupBy("session_id", "zone").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.countDistinct("pos").alias("n_positions"),
        F.array_sort(F.collect_set("signal")).alias("signals"))


def zone_windows(found: DataFrame, lengths: DataFrame, most: int = MAX_WINDOW, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """Line positions shown for a zone: three each side, the middle left out when too long."""
    sized = keyed_lookup(found, lengths, S, ["session_id", "zone"])
    lo = F.greatest(F.col("first_pos") - CONTEXT, F.lit(0))
    hi = F.least(F.col("last_pos") + CONTEXT, F.col("n_lines") - 1)
    n = hi - lo + 1
    shown = F.when(n <= most, F.sequence(lo, hi)).otherwise(
        F.concat(F.sequence(lo, lo + head - 1), F.sequence(hi - tail + 1, hi)))
    return sized.select("session_id", "zone", F.greatest(n - most, F.lit(0)).alias("_over"),
                        F.explode(shown).alias("seg_pos"), lo.alias("_lo")).withColumn(
        "after_elision", (F.col("_over") > 0) & (F.col("seg_pos") - F.col("_lo") >= head)).drop("_over", "_lo")


def assemble_stories(events: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """(session_id, start_pos, end_pos) regions from start and end events.

    ``events``: session_id, zone, pos, kind ('start' or 'end'); walked by zone, then position, ends
    first. Between two ends only the starts that pass the highest start so far count, so the open
    position is a running maximum and the walk needs no per-session loop. A start past the open one
    closes it just before; an end without an open story reaches back to the region before; a story
    left open runs to the last line; a session without events is one story. The marked events, read
    several times below, are checkpointed.
    """
    is_end = F.col("kind") == "end"
    order = ["zone", "pos", "_k", "_dup"]
    e = (events.withColumn("_k", F.when(is_end, 0).otherwise(1))
         .groupBy("session_id", "zone", "pos", "kind", "_k").agg(F.count(F.lit(1)).alias("_c"))
         .withColumn("_dup", F.explode(F.sequence(F.lit(1).cast("long"), "_c"))).drop("_c"))
    e = scan(e, S, order, block_of("zone", block), ends=RunSum(F.when(is_end, 1).otherwise(0).cast("long"), inclusive=False))
    e = materialize(scan(e, [*S, "ends"], order, block_of("zone", block), open=RunMax(F.when(~is_end, F.col("pos")))))
    # the end of the region an end event closes, seen by the next end
    close = F.when(is_end, F.greatest(F.coalesce("open", "pos"), "pos"))
    e = scan(e, S, order, block_of("zone", block), last_close=LastSeen(close), next_any=Next(F.lit(1)))
    closing = (F.when(is_end & F.col("open").isNull(),
                      F.struct(F.least(F.coalesce(F.col("last_close") + 1, F.lit(0)), F.col("pos")).alias("s"), F.col("pos").alias("e")))
               .when(is_end, F.struct(F.col("open").alias("s"), F.greatest("open", "pos").alias("e")))
               .when(F.col("pos") > F.col("open"), F.struct(F.col("open").alias("s"), (F.col("pos") - 1).alias("e"))))
    closed = e.withColumn("_r", closing).filter("_r is not null").select("session_id", "_r.s", "_r.e")
    tail = e.filter(F.col("next_any").isNull() & ~is_end).select("session_id", F.greatest("open", "pos").alias("s"))
    n_events = e.select("session_id").distinct()
    open_tail = tail.join(lengths, S).select("session_id", "s", (F.col("n_lines") - 1).cast("long").alias("e"))
    whole = lengths.join(n_events, S, "left_anti").select("session_id", F.lit(0).alias("s"), (F.col("n_lines") - 1).alias("e"))
    return materialize(closed.unionByName(open_tail).unionByName(whole).select(
        "session_id", F.col("s").cast("long").alias("start_pos"), F.col("e").cast("long").alias("end_pos")))


def lines_of_regions(segments: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """Each line of each region (regions may overlap): a range join on position."""
    points = segments.withColumn("_p", F.col("seg_pos").cast("long")).withColumn("_q", F.col("_p"))
    return overlap_join(points, regions, S, width, "_p", "_q", "start_pos", "end_pos", closed=True).drop("_p", "_q")


def drop_winddown(regions: DataFrame, segments: DataFrame, width: int, threshold: float = 0.34,
                  patterns: list[str] = tx.CUES["WINDDOWN"]) -> DataFrame:
    """Regions less than ``threshold`` wind-down lines; a session keeps all when none would stay."""
    lines = lines_of_regions(segments.filter(tx.strip("text") != ""), regions, width)
    share = lines.groupBy("session_id", "start_pos", "end_pos").agg(
        F.avg(tx.is_winddown("text", patterns).cast("int")).alias("_w"))
    scored = regions.join(share, ["session_id", "start_pos", "end_pos"], "left").withColumn("winddown", F.coalesce("_w", F.lit(0.0))).drop("_w")
    least = scored.groupBy("session_id").agg(F.min("winddown").alias("_least"))
    kept = keyed_lookup(scored, least, S, ["start_pos", "end_pos"])
    return kept.filter((F.col("winddown") < threshold) | (F.col("_least") >= threshold)).drop("_least")


def merge_regions(regions: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Fold consecutive regions of the same group; ``groups``: session_id, region, grp."""
    first = groups.groupBy("session_id", "region").agg(F.min("grp").alias("grp"))
    labelled = regions.join(first, ["session_id", "region"], "left")
    runs = number_runs(labelled, S, ["region"], block_of("region", block), F.col("grp"),
                       starts=lambda prev, row: prev.isNull() | row.isNull() | (prev != row))
    return runs.groupBy("session_id", "run").agg(
        F.min_by("start_pos", "region").alias("start_pos"), F.max_by("end_pos", "region").alias("end_pos")).drop("run")


def refine_starts(regions: DataFrame, moves: DataFrame, block: int, lookback: int = 40) -> DataFrame:
    """Move a region's start earlier where asked, not past the region before nor ``lookback`` lines."""
    seen = scan(regions, S, ["region"], block_of("region", block), _pe=Prev(F.col("end_pos")))
    lower = F.coalesce(F.col("_pe") + 1, F.lit(0))
    asked = seen.join(moves, ["session_id", "region"], "left")
    allowed = (F.col("new_pos") >= F.greatest(lower, F.col("start_pos") - lookback)) & (F.col("new_pos") < F.col("start_pos"))
    return asked.select("session_id", "region", F.when(allowed, F.col("new_pos")).otherwise(F.col("start_pos")).alias("start_pos"), "end_pos")


def resolve_stories(stories: DataFrame, segments: DataFrame) -> DataFrame:
    """Stories with the positions of their ids (bounds in order); unknown ids are left out."""
    ids = segments.select("session_id", "seg_id", F.col("seg_pos").cast("long").alias("p"))
    a = stories.join(ids.select("session_id", F.col("seg_id").alias("start_id"), F.col("p").alias("_a")), [*S, "start_id"])
    b = a.join(ids.select("session_id", F.col("seg_id").alias("end_id"), F.col("p").alias("_b")), [*S, "end_id"])
    return b.withColumn("start_pos", F.least("_a", "_b")).withColumn("end_pos", F.greatest("_a", "_b")).drop("_a", "_b")


def tag_stories(segments: DataFrame, stories: DataFrame, width: int) -> DataFrame:
    """Segments with the story they lie in; of overlapping stories the later one wins."""
    resolved = resolve_stories(stories, segments).select("session_id", "story_idx", "start_pos", "end_pos")
    inside = lines_of_regions(segments.select("session_id", "seg_pos"), resolved, width)
    tags = inside.groupBy("session_id", "seg_pos").agg(F.max("story_idx").alias("story_idx"))
    return segments.drop("story_idx").join(tags, ["session_id", "seg_pos"], "left")


def region_text(segments: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """Non-empty lines of each region with their place from both ends (1-based)."""
    lines = lines_of_regions(segments.filter(tx.strip("text") != ""), regions, width)
    keys = ["session_id", "start_pos", "end_pos"]
    numbered = running_number(lines, keys, ["seg_pos"], block_of("seg_pos", 65536), "line_no")
    total = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
    return keyed_lookup(numbered, total, keys, ["seg_pos"])


def head_tail(lines: DataFrame, head: int = 4, tail: int = 3) -> DataFrame:
    """Only the first and last lines of long regions."""
    return lines.filter((F.col("n_lines") <= head + tail) | (F.col("line_no") <= head) | (F.col("line_no") > F.col("n_lines") - tail))


def head_mid_tail(lines: DataFrame, head: int = 6, mid: int = 3, tail: int = 3) -> DataFrame:
    """First lines, ``mid`` evenly spaced ones and last lines of long regions."""
    n, i = F.col("n_lines"), F.col("line_no")
    spaced = F.lit(False)
    for k in range(1, mid + 1):
        spaced = spaced | (i - 1 == F.floor(n * k / (mid + 1)))
    return lines.filter((n <= head + mid + tail) | (i <= head) | (i > n - tail) | spaced)


def story_labels(stories: DataFrame) -> DataFrame:
    """One line per session: first title, how many more, and the worlds in order of appearance."""
    title, world = F.btrim(F.coalesce("title", F.lit(""))), F.btrim(F.coalesce("world", F.lit("")))
    s = stories.withColumn("title", title).withColumn("world", world)
    heads = s.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_stories"), F.count_if(F.col("world") == "").alias("n_original"),
        F.min_by("title", F.when(F.col("title") != "", F.col("story_idx"))).alias("_title"))
    named = s.filter("world <> ''").groupBy("session_id", "world").agg(F.min("story_idx").alias("_at"))
    listed = named.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "world"))),
                                                                      lambda x: x["world"]), " · ").alias("worlds"))
    both = heads.join(listed, S, "left").withColumn("worlds", F.coalesce("worlds", F.lit("")))
    n = F.col("n_stories")
    more = F.when(n > 1, F.concat(F.lit(" + "), (n - 1).cast("string"), F.lit(" more"))).otherwise("")
    originals = F.when(F.col("n_original") > 0, F.concat(
        F.lit(" + "), F.col("n_original").cast("string"), F.when(F.col("n_original") == 1, " original").otherwise(" originals"))).otherwise("")
    label = (F.when(F.col("_title").isNotNull(), F.concat("_title", more, F.when(F.col("worlds") != "", F.concat(F.lit(" · "), "worlds")).otherwise("")))
             .when(F.col("worlds") != "", F.concat("worlds", originals))
             .otherwise(F.concat(n.cast("string"), F.when(n == 1, " story").otherwise(" stories"))))
    return both.select("session_id", "n_stories", "worlds", label.alias("label"))


def retag_stories(segments: DataFrame, stories: DataFrame, width: int) -> DataFrame:
    """Segments with old story tags taken off and new ones put on."""
    return tag_stories(segments.drop("story_idx", "title", "world"), stories, width)


def story_names(tagged: DataFrame, names: DataFrame) -> DataFrame:
    """(session_id, story_idx, rank, name): the distinct written names of each story in order, one row per name.

    ``tagged``: segments with story_idx; ``names``: session_id, seg_pos, surface. Lines outside stories give none.
    """
    inside = tagged.filter("story_idx is not null").select("session_id", "seg_pos", "story_idx")
    found = names.join(inside, ["session_id", "seg_pos"]).select("session_id", "story_idx", F.col("surface").alias("name")).distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("session_id", "story_idx").orderBy("name")))
