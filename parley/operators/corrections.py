"""Applying, undoing and queueing spelling corrections."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from parley.functions import text as tx
from parley.operators.filters import word_text
from parley.operators.names import AT, SEG
from parley.operators.phrases import phrases_in
from parley.operators.skew import keyed_lookup
from parley.session import materialize, staged

HISTORY = ArrayType(StructType([StructField(c, StringType()) for c in ("stage", "from", "to")]))


def variant_map(entries: DataFrame) -> DataFrame:
    """(transcribed, correct) from library entries: entry_pos, canonical, variants.

    Variants equal to their canonical are skipped, aliases are not used, a later entry wins.
    """
    rows = entries.select("entry_pos", "canonical", F.posexplode("variants").alias("_i", "_v")).withColumn("transcribed", F.lower("_v"))
    rows = rows.filter(F.col("transcribed") != F.lower("canonical"))
    return rows.groupBy("transcribed").agg(F.max_by("canonical", F.struct("entry_pos", "_i")).alias("correct"))


def variant_scan(texts: DataFrame, ids: Sequence[str], variants: DataFrame, text: str = "text") -> DataFrame:
    """Known variants, of any number of words, found in each text as whole words: (ids, transcribed, correct).

    ``transcribed`` is the first place as the text has it; apostrophes, hyphens and spaces must agree.
    """
    wanted = variants.select(F.col("transcribed").alias("_variant"), "correct")
    return phrases_in(texts, ids, text, wanted, "_variant", written="transcribed").select(*ids, "transcribed", "correct")


def last_mapping(corrections: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Lookup of single-word corrections; of equal keys the highest ``ordinal`` wins."""
    key = F.lower(tx.strip("transcribed"))
    one = corrections.filter(~tx.strip("transcribed").contains(" "))
    return one.groupBy(*scope, key.alias("_key")).agg(F.max_by("correct", "ordinal").alias("_to"))


def apply_corrections(words: DataFrame, corrections: DataFrame, stage: str, scope: Sequence[str] = ()) -> DataFrame:
    """Rewrite words by a map (transcribed, correct, ordinal), keeping punctuation, possessive and space.

    ``original`` is set once; each change is added to ``corrections``.
    """
    stem, suffix, punct = tx.split_punct("word")
    w = words.withColumn("_bare", stem).withColumn("_tail", F.concat(suffix, punct)).withColumn("_key", F.lower("_bare"))
    m = keyed_lookup(w, last_mapping(corrections, scope), [*scope, "_key"], AT, "left")
    hit = F.col("_to").isNotNull()
    step = F.array(F.struct(F.lit(stage).alias("stage"), F.col("_bare").alias("from"), F.col("_to").alias("to"))).cast(HISTORY)
    old = F.coalesce(F.col("corrections"), F.array().cast(HISTORY)) if "corrections" in words.columns else F.array().cast(HISTORY)
    original = F.col("original") if "original" in words.columns else F.lit(None).cast("string")
    return (m.withColumn("original", F.when(hit, F.coalesce(original, tx.strip("word"))).otherwise(original))
            .withColumn("corrections", F.when(hit, F.concat(old, step)).otherwise(old))
            .withColumn("word", F.when(hit, F.concat(F.when(F.col("word").startswith(" "), " ").otherwise(""), "_to", "_tail"))
                        .otherwise(F.col("word")))
            .drop("_bare", "_tail", "_key", "_to"))


def heal_text(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segment text put together from its words; segments without words keep theirs."""
    rebuilt = word_text(words).select(*SEG, "rebuilt")
    return segments.join(rebuilt, SEG, "left").withColumn("text", F.coalesce("rebuilt", "text")).drop("rebuilt")


def apply_at(words: DataFrame, positions: DataFrame, stage: str) -> DataFrame:
    """Rewrite exactly the listed words (AT, canonical); possessives are not split here."""
    m = words.join(positions.select(*AT, F.col("canonical").alias("_to")), AT, "left")
    hit = F.col("_to").isNotNull()
    s = tx.strip("word")
    tail = F.when(s.rlike(tx.TRAILING_PUNCT), F.regexp_extract(s, tx.TRAILING_PUNCT, 2)).otherwise("")
    bare = F.when(s.rlike(tx.TRAILING_PUNCT), F.regexp_extract(s, tx.TRAILING_PUNCT, 1)).otherwise(s)
    step = F.array(F.struct(F.lit(stage).alias("stage"), bare.alias("from"), F.col("_to").alias("to"))).cast(HISTORY)
    old = F.coalesce(F.col("corrections"), F.array().cast(HISTORY)) if "corrections" in words.columns else F.array().cast(HISTORY)
    original = F.col("original") if "original" in words.columns else F.lit(None).cast("string")
    return (m.withColumn("original", F.when(hit, F.coalesce(original, s)).otherwise(original))
            .withColumn("corrections", F.when(hit, F.concat(old, step)).otherwise(old))
            .withColumn("word", F.when(hit, F.concat(F.when(F.col("word").startswith(" "), " ").otherwise(""), "_to", tail)).otherwise(F.col("word")))
            .drop("_to"))


def revert_stage(words: DataFrame, stage: str = "llm") -> DataFrame:
    """Put back the original of every word a stage touched; a touched word without one is an error."""
    touched = F.exists("corrections", lambda c: c["stage"].contains(stage))
    ok = F.assert_true(~touched | F.col("original").isNotNull(), F.lit("corrected word without its original")).isNull()
    lead = F.when(F.col("word").startswith(" "), " ").otherwise("")
    return (words.withColumn("_t", touched & ok)
            .withColumn("word", F.when(F.col("_t"), F.concat(lead, "original")).otherwise(F.col("word")))
            .withColumn("original", F.when(~F.col("_t"), F.col("original")))
            .withColumn("corrections", F.when(F.col("_t"), F.array().cast(HISTORY)).otherwise(F.col("corrections"))).drop("_t"))


def shape_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Segments whose id or word count differs between two word tables (empty when the shape held)."""
    def shape(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*SEG).agg(F.count(F.lit(1)).alias(name))
    both = shape(before, "n_before").join(shape(after, "n_after"), SEG, "full_outer")
    return both.filter(~F.col("n_before").eqNullSafe(F.col("n_after")))


def correction_audit(words: DataFrame, prefix: str = "namefix") -> DataFrame:
    """Words whose history has a stage of this family: before, after, last such stage and the line."""
    mine = F.filter("corrections", lambda c: c["stage"].startswith(prefix))
    touched = words.withColumn("_m", mine).filter(F.size("_m") > 0)
    lines = word_text(words.join(touched.select(*SEG).distinct(), SEG, "left_semi")).select(*SEG, tx.strip("rebuilt").alias("line"))
    last = F.element_at("_m", -1)
    return touched.select(*AT, last["from"].alias("before"), tx.strip("word").alias("after"), last["stage"].alias("stage")).join(lines, SEG)


def occurrences_by_pattern(texts: DataFrame, ids: Sequence[str], names: DataFrame, text: str = "text") -> DataFrame:
    """(canonical, n, n_variants, n_texts): how often each name's variants occur.

    ``names`` has canonical, variant (any number of words) and, optionally, ``prefix``: true where the variant may go on,
    as in "pandava" for "pandavas".

    Each variant is searched and counted once, however many names have it; texts with several variants are
    counted once per set of variants that some name has.
    """
    keys = [c for c in ("variant", "prefix") if c in names.columns]
    names = names.select("canonical", "variant", *[F.coalesce("prefix", F.lit(False)).alias("prefix")][:len(keys) - 1]).distinct()
    hits = staged(phrases_in(texts, ids, text, names.select(*keys).distinct(), "variant", "prefix" if "prefix" in keys else None))
    counts = hits.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.expr(f"count({', '.join(ids)})").alias("_texts"))  # a text and key have one row
    found = staged(names.join(counts, keys).groupBy("canonical").agg(
        F.sum("_n").alias("n"), F.countDistinct("variant").alias("n_variants"), F.array_sort(F.collect_set(F.struct(*keys))).alias("_set"),
        F.max("_texts").alias("_texts")))
    several = found.filter(F.size("_set") > 1).select("_set").distinct()
    members = several.select("_set", F.explode("_set").alias("_v")).select("_set", "_v.*")
    together = hits.join(members, keys).select("_set", *ids).distinct().groupBy("_set").agg(F.count(F.lit(1)).alias("_all"))
    return found.join(together, "_set", "left").select("canonical", "n", "n_variants", F.coalesce("_all", "_texts").alias("n_texts"))


def queue_sessions(pending: DataFrame) -> DataFrame:
    """(world, key, canonical, session_id, n_occurrences): the sessions behind each queue entry, one row each."""
    return pending.groupBy("world", "key", "canonical", "session_id").agg(F.sum("n_occurrences").alias("n_occurrences"))


def queue_rollup(pending: DataFrame) -> DataFrame:
    """Waiting corrections by world, heard form and spelling with their sessions and uses."""
    return pending.groupBy("world", "key", "canonical").agg(
        F.countDistinct("session_id").alias("n_sessions"), F.sum("n_occurrences").alias("n_occurrences"))


def bless(dictionary: DataFrame, decided: DataFrame) -> DataFrame:
    """Dictionary with the decided (world, heard, canonical) variants added, compared without case."""
    held = dictionary.select("world", F.lower("canonical").alias("_c"), F.lower("variant").alias("_v")).distinct()
    # one row per variant before the join: a decision may come once per use
    asked = (decided.groupBy("world", "canonical", "heard").agg(F.lit(1).alias("_n"))
             .withColumn("_c", F.lower("canonical")).withColumn("_v", F.lower("heard")).filter("_c <> _v")
             .groupBy("world", "_c", "_v").agg(F.min("canonical").alias("canonical"), F.min("heard").alias("variant")))
    fresh = asked.join(held, ["world", "_c", "_v"], "left_anti")
    return dictionary.unionByName(fresh.select("world", "canonical", "variant"))


def split_pending(pending: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences a person chose to apply, and the ones that keep waiting."""
    keys = ["world", "key", "canonical", *AT]
    return pending.join(chosen.select(*keys).distinct(), keys, "left_semi"), pending.join(chosen.select(*keys).distinct(), keys, "left_anti")


def move_groups(groups: DataFrame, moves: DataFrame) -> DataFrame:
    """Groups with their state replaced where ``moves`` (session_id, key, state) says so."""
    m = moves.groupBy("session_id", "key").agg(F.max("state").alias("_s"))
    return groups.join(m, ["session_id", "key"], "left").withColumn("state", F.coalesce("_s", "state")).drop("_s")


def alignment_merge(words: DataFrame, segments: DataFrame, aligned: DataFrame, min_confidence: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Merge forced-alignment times into words: (words, segments with status and widened bounds).

    ``aligned``: session_id, seg_pos, token_no, s, e, conf for the alignable tokens of the text.
    As many text tokens as words: times are overwritten. More, within twice or four extra, and
    trusted on average: words are rebuilt from the text. Otherwise the segment stays as it is.
    """
    toks = tx.tokens("text")
    facts = (segments.filter(~F.col("is_gap")).select(*SEG, "start", "end", toks.alias("_toks"), "speaker_label")
             .join(words.groupBy(*SEG).agg(F.count(F.lit(1)).alias("_nw")), SEG)
             .join(aligned.groupBy(*SEG).agg(F.avg("conf").alias("_conf")), SEG, "left"))
    nt, nw = F.size("_toks"), F.col("_nw")
    status = (F.when(F.col("_conf").isNull(), "skipped").when(nt == nw, "realigned")
              .when((nt > nw) & (nt <= F.greatest(2 * nw, nw + 4)) & (F.col("_conf") >= min_confidence), "rescued").otherwise("guarded"))
    facts = staged(facts.withColumn("status", status))
    spans = aligned.select(*SEG, F.col("token_no").alias("word_index"), "s", "e", F.round("conf", 3).alias("_c"))
    same = (words.join(facts.filter("status <> 'rescued'").select(*SEG, "status"), SEG, "left").filter(
        F.col("status").isNotNull()).join(spans, AT, "left"))
    moved = (F.col("status") == "realigned") & F.col("s").isNotNull()
    kept = same.select(*AT, "word", F.when(moved, F.col("s")).otherwise(F.col("start")).alias("start"),
                       F.when(moved, F.col("e")).otherwise(F.col("end")).alias("end"), F.when(moved, F.col("_c")).alias("align_conf"))
    surfaces = facts.filter("status = 'rescued'").select(*SEG, F.col("start").alias("_seg0"), F.posexplode("_toks").alias("word_index", "word")).join(spans, AT, "left")
    before = Window.partitionBy(*SEG).orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last("e", ignorenulls=True).over(before), F.col("_seg0"))
    rebuilt = surfaces.select(*AT, F.concat(F.lit(" "), "word").alias("word"), F.coalesce("s", held).alias("start"),
                              F.coalesce("e", held).alias("end"), F.coalesce("_c", F.lit(0.0)).alias("align_conf"))
    untouched = words.join(facts.select(*SEG), SEG, "left_anti").select(*AT, "word", "start", "end", F.lit(None).cast("double").alias("align_conf"))
    merged = kept.unionByName(rebuilt).unionByName(untouched)
    changed = facts.filter(F.col("status").isin("realigned", "rescued")).select(*SEG)
    edge = merged.join(changed, SEG, "left_semi").groupBy(*SEG).agg(F.min_by("start", "word_index").alias("_s"), F.max_by("end", "word_index").alias("_e"))
    wide = (segments.join(edge, SEG, "left").join(facts.select(*SEG, "status"), SEG, "left")
            .withColumn("start", F.least("start", "_s")).withColumn("end", F.greatest("end", "_e"))
            .withColumn("status", F.coalesce("status", F.lit("untouched"))).drop("_s", "_e"))
    return merged, wide
