"""View-time overlays on flags: human verdicts, tiers, canon de-duplication, groups and roll-ups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.skew import keyed_lookup

ROSTER, SPELLING, CANON = "m9a", "m9b", "m9c"


def bare(col: Column | str) -> Column:
    """Display spelling without case and edge punctuation."""
    return F.regexp_replace(F.lower(col), r"""^[.,?!'"]+|[.,?!'"]+$""", "")


def apply_verdicts(flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Flags a person did not overrule.

    ``verdicts``: session_id, type, name, cleaned. 'not_canon' drops a canon group by its proposed
    name, 'correct' drops a spelling from both name detectors; roster flags are not touched.
    """
    not_canon = verdicts.filter("type = 'not_canon'").select("session_id", F.col("name").alias("canonical")).distinct().withColumn("_n", F.lit(True))
    correct = verdicts.filter("type = 'correct'").select("session_id", "cleaned").distinct().withColumn("_c", F.lit(True))
    marked = keyed_lookup(keyed_lookup(flags, not_canon, ["session_id", "canonical"], ["flag_id"], "left"),
                          correct, ["session_id", "cleaned"], ["flag_id"], "left")
    gone = ((F.col("detector_id") == CANON) & F.col("_n").isNotNull()) | (F.col("detector_id").isin(SPELLING, CANON) & F.col("_c").isNotNull())
    return marked.filter(~gone).drop("_n", "_c")


def visible_spellings(spellings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cluster spellings without the ones a person called correct."""
    correct = verdicts.filter("type = 'correct'").select("session_id", F.col("cleaned").alias("_b")).distinct()
    return spellings.withColumn("_b", bare("spelling")).join(correct, ["session_id", "_b"], "left_anti").drop("_b")


def verdict_staleness(flags: DataFrame, verdicts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """'not_canon' verdicts whose name is still flagged but with other spellings than at review.

    ``reviewed``: session_id, name, cleaned (one row per spelling seen then). ``has_review`` on a
    verdict says that spellings were noted, be it none: a noted empty set is stale once the name has
    flags, a verdict without a note never is. Sets are compared row by row, so a name with many
    spellings is not gathered.
    """
    keys = ["session_id", "name"]
    v = verdicts.filter("type = 'not_canon'").groupBy(*keys).agg(F.bool_or("has_review").alias("_noted"))
    now = flags.filter(F.col("detector_id") == CANON).select("session_id", F.col("canonical").alias("name"), "cleaned", F.lit(1).alias("_now"), F.lit(0).alias("_then"))
    then = reviewed.select(*keys, "cleaned", F.lit(0).alias("_now"), F.lit(1).alias("_then"))
    per = now.unionByName(then).groupBy(*keys, "cleaned").agg(F.max("_now").alias("_now"), F.max("_then").alias("_then"))
    state = per.groupBy(*keys).agg(F.max("_now").alias("_any"), F.bool_or(F.col("_now") != F.col("_then")).alias("_diff"))
    return v.join(state, keys, "left").select(
        *keys, F.coalesce(F.col("_noted") & (F.col("_any") == 1) & F.col("_diff"), F.lit(False)).alias("stale"))


def with_tiers(flags: DataFrame, votes: int = 3) -> DataFrame:
    """Canon flags with their confidence tier; other detectors have none."""
    tier = F.when(F.coalesce("confident", F.lit(False)), "confident").when(F.coalesce("vote_count", F.lit(0)) >= votes, "best_guess").otherwise("low")
    return flags.withColumn("tier", F.when(F.col("detector_id") == CANON, tier))


def drop_canon_owned(flags: DataFrame) -> DataFrame:
    """Spelling clusters go when a shown canon flag claims any of their spellings. Needs tiers."""
    claimed = flags.filter((F.col("detector_id") == CANON) & (F.col("tier") != "low")).select("session_id", "cleaned").distinct()
    spelled = flags.filter(F.col("detector_id") == SPELLING).select("session_id", "cluster_id", "cleaned").distinct()
    owned = spelled.join(claimed, ["session_id", "cleaned"], "left_semi").select("session_id", "cluster_id").distinct().withColumn("_o", F.lit(True))
    marked = keyed_lookup(flags, owned, ["session_id", "cluster_id"], ["flag_id"], "left")
    return marked.filter(~((F.col("detector_id") == SPELLING) & F.col("_o").isNotNull())).drop("_o")


def overlaid(flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The shown flags: verdicts first, then tiers, then de-duplication (the order matters)."""
    return drop_canon_owned(with_tiers(apply_verdicts(flags, verdicts)))


def rollup(flags: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """Shown flags per session and detector, with detector totals ('all') and any-stale marks."""
    shown = F.count_if((F.col("detector_id") != CANON) | (F.col("tier") != "low"))
    counts = flags.groupBy("session_id", "detector_id").agg(shown.alias("n_flags"))
    totals = counts.groupBy("detector_id").agg(F.sum("n_flags").alias("n_flags")).withColumn("session_id", F.lit("all"))
    out = counts.unionByName(totals)
    if stale is not None:
        s = stale.groupBy("session_id").agg(F.bool_or("stale").alias("stale"))
        out = out.join(s, "session_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    return out


def _group_key() -> Column:
    return (F.when(F.col("detector_id") == ROSTER, F.col("canonical")).when(F.col("detector_id") == SPELLING, F.col("cluster_id"))
            .otherwise(F.coalesce("canonical", "cleaned")))


def flag_spellings(flags: DataFrame) -> DataFrame:
    """(session_id, detector_id, group_key, spelling, n): the distinct spellings of each shown group."""
    return flags.groupBy("session_id", "detector_id", _group_key().alias("group_key"), bare("token").alias("spelling")).agg(F.count(F.lit(1)).alias("n"))


def flag_groups(flags: DataFrame) -> DataFrame:
    """Flags gathered as shown: roster names by person, spellings by cluster, canon names by name."""
    return flags.groupBy("session_id", "detector_id", _group_key().alias("group_key")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(bare("token")).alias("n_spellings"))


def flag_lines(flags: DataFrame, segments: DataFrame) -> DataFrame:
    """Flags with their segment's text, bounds and speaker; nulls when the segment is gone."""
    s = segments.select("session_id", "seg_pos", F.btrim("text").alias("segment_text"), F.col("start").alias("segment_start"),
                        F.col("end").alias("segment_end"), F.col("speaker_label").alias("segment_speaker"))
    return flags.join(s, ["session_id", "seg_pos"], "left")


def toggle_verdicts(verdicts: DataFrame, sent: DataFrame, keys: Sequence[str] = ("session_id", "type", "name", "cleaned")) -> DataFrame:
    """Verdicts after one more was sent: the same one again takes it back."""
    same = [verdicts[k].eqNullSafe(sent[k]) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return verdicts.join(sent, cond, "left_anti").unionByName(sent.join(verdicts, cond, "left_anti"))
