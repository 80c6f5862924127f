"""Predicates over words and segments: suspicious, duplicate, low-confidence, mismatching."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.phrases import phrases_in
from parley.operators.runs import runs_in_segment
from parley.operators.scans import later_copies

SEG = ["session_id", "seg_pos"]


def clean_transcript(segments: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with text and length, and the words of positive length in them."""
    kept = segments.filter((tx.strip("text") != "") & (F.col("end") > F.col("start")))
    inside = words.filter("end > start").join(kept.select(*SEG), SEG, "left_semi")
    return kept, inside


def silence_gap(has_speaker: Column | None = None) -> Column:
    """Nobody detected and nothing covered; a word never enriched (no coverage) does not match."""
    hit = F.col("speaker_label").isNull() & (F.coalesce("coverage", F.lit(1.0)) == 0)
    return hit if has_speaker is None else hit & has_speaker


def near_zero(threshold: float = 0.01) -> Column:
    return F.coalesce(F.col("probability") < threshold, F.lit(False))


def suspicious_words(words: DataFrame) -> DataFrame:
    """Silence-gap and near-zero words that are alone in their segment."""
    alone = F.count(F.lit(1)).over(Window.partitionBy(*SEG)) == 1
    return (words.withColumn("_one", alone)
            .withColumn("silence_gap", F.col("_one") & silence_gap())
            .withColumn("near_zero", F.col("_one") & near_zero()).drop("_one"))


def duplicate_segments(segments: DataFrame, keys: Sequence[str], order: str, block: Column, fold_case: bool = False) -> DataFrame:
    """Later occurrences of a text already seen in the session; blank texts do not count."""
    body = tx.strip("text")
    keyed = segments.filter(body != "").withColumn("_key", F.sha2(F.lower(body) if fold_case else body, 256))
    return later_copies(keyed, [*keys, "_key"], order, block).drop("_key")


def filter_reasons(words: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Per segment the reasons it deserves a look, as an array in fixed order."""
    flags = suspicious_words(words).groupBy(*SEG).agg(
        F.bool_or("silence_gap").alias("silence_gap"), F.bool_or("near_zero").alias("near_zero"))
    dup = duplicates.select(*SEG).withColumn("_dup", F.lit(True))
    tagged = flags.join(dup, SEG, "left")
    reasons = F.array_compact(F.array(F.when(F.col("silence_gap"), "silence-gap"), F.when(F.col("near_zero"), "near-zero"),
                                      F.when(F.col("_dup"), "duplicate")))
    return tagged.select(*SEG, reasons.alias("reasons")).filter(F.size("reasons") > 0)


def probability_band(p: Column | str = "probability") -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= 0.7, "high").when(p >= 0.3, "mid").otherwise("low")


def match_band(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s.isNull(), "grey").when(s >= 0.75, "green").when(s >= 0.60, "yellow").otherwise("red")


def low_confidence(words: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Words under the threshold, listed per segment in order."""
    return (words.filter(F.col("probability") < threshold).groupBy(*SEG)
            .agg(F.array_sort(F.collect_list(F.struct("word_index", "word", "probability"))).alias("words")))


def segment_class() -> Column:
    timed = F.col("end") > F.col("start")
    return (F.when(timed & F.col("is_gap"), "unintelligible").when(timed, "real").otherwise("empty"))


def word_text(words: DataFrame, keys: Sequence[str] = SEG, name: str = "rebuilt") -> DataFrame:
    """Surfaces of each segment put together in order, and their number."""
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "word"))), lambda s: s["word"]), "").alias(name),
        F.count(F.lit(1)).alias("n_stream"))


def text_word_mismatch(segments: DataFrame, words: DataFrame, per_second: float = 1.0) -> DataFrame:
    """Segments whose text differs from their words: dropped, name or added; with pace."""
    both = segments.join(word_text(words), SEG)
    n_text, n_words = F.size(tx.tokens("text")), F.size(tx.tokens("rebuilt"))
    kind = (F.when(tx.strip("text") == tx.strip("rebuilt"), None).when(n_text > n_words, "dropped")
            .when(n_text == n_words, "name").otherwise("added"))
    dur = F.greatest(F.col("end") - F.col("start"), F.lit(0)) / F.lit(per_second)
    wps = F.when(dur > 0, n_words / F.nullif(dur, F.lit(0.0))).otherwise(F.lit(999.0))
    return (both.withColumn("kind", kind).filter("kind is not null")
            .select(*SEG, "kind", n_words.alias("n_words"), dur.alias("seconds"), wps.alias("wps"),
                    ((dur < 0.30) | (wps > 6.0)).alias("crammed")))


def bare_word(word: Column) -> Column:
    """Letters of a word's surface; null without any."""
    return F.get(F.transform(F.array(tx.letters(word["word"])), lambda x: F.when(x != "", x)), 0)


def garbage_census(lines: DataFrame, coded: DataFrame, owned: DataFrame) -> DataFrame:
    """Script and symbol tokens, repeat runs and zero-probability runs, each with a coded flag.

    ``lines`` are segments with their ``words`` as arrays (see ``runs_in_segment``); only findings are moved. ``coded``
    lists segments a person labelled; repeat runs skip ``owned`` segments.
    """
    def finding(cls: Column, w: Column, token: Column) -> Column:
        return F.struct(cls.alias("cls"), w["word_index"].alias("word_index"), w["start"].alias("start"), w["end"].alias("end"), token.alias("token"))

    each = F.transform("words", lambda w: finding(F.lit(None).cast("string"), w, w["word"]))
    repeats = F.transform(runs_in_segment(F.col("words"), bare_word, 3), lambda r: finding(
        F.lit("repeat"), r, F.concat(tx.strip(r["first_word"]), F.lit(" x"), r["length"].cast("string"))))
    zero = F.transform(runs_in_segment(F.col("words"), lambda w: F.when(w["probability"] < 0.01, F.lit(1)), 1),
                       lambda r: finding(F.lit("zeroprob"), r, tx.strip(r["first_word"])))
    found = lines.select(*SEG, F.inline(F.concat(each, repeats, zero)))
    odd = F.col("cls").isNull()
    found = (found.withColumn("token", F.when(odd, tx.strip("token")).otherwise(F.col("token")))
             .withColumn("cls", F.when(odd, tx.token_class("token")).otherwise(F.col("cls"))).filter("cls is not null"))
    marks = (coded.select(*SEG, F.lit(True).alias("coded"), F.lit(False).alias("_owned"))
             .unionByName(owned.select(*SEG, F.lit(False).alias("coded"), F.lit(True).alias("_owned")))
             .groupBy(*SEG).agg(F.bool_or("coded").alias("coded"), F.bool_or("_owned").alias("_owned")))
    both = found.join(marks, SEG, "left").na.fill(False, ["coded", "_owned"])
    return both.filter(~(F.col("_owned") & (F.col("cls") == "repeat"))).select("cls", *SEG, "word_index", "start", "end", "token", "coded")


def census_table(findings: DataFrame) -> DataFrame:
    """Uncoded and coded counts per session and class, with the grand total under 'all'."""
    cells = []
    for cls in ("script", "symbol", "repeat", "zeroprob"):
        here = F.col("cls") == cls
        cells += [F.count_if(here & ~F.col("coded")).alias(f"{cls}_uncoded"), F.count_if(here & F.col("coded")).alias(f"{cls}_coded")]
    return findings.rollup("session_id").agg(*cells).withColumn("session_id", F.coalesce("session_id", F.lit("all")))


def worst_picks(findings: DataFrame, n: int) -> DataFrame:
    """The ``n`` worst uncoded findings: by class, then longest."""
    rank = F.when(F.col("cls") == "script", 0).when(F.col("cls") == "repeat", 1).when(F.col("cls") == "zeroprob", 2).otherwise(3)
    return (findings.filter(~F.col("coded")).withColumn("rank", rank).withColumn("span", F.col("end") - F.col("start"))
            .orderBy("rank", F.desc("span"), "session_id", "seg_pos", "word_index", "cls").limit(n))


def mentions(texts: DataFrame, ids: Sequence[str], text: str, names: DataFrame) -> DataFrame:
    """Ids of the texts holding a known name of over two letters as whole words (case-insensitive)."""
    wanted = names.filter(F.length("name") > 2).select(F.lower("name").alias("name")).distinct()
    return phrases_in(texts, ids, text, wanted, "name").select(*ids).distinct()


def char_offsets(words: DataFrame) -> DataFrame:
    """Offset of each word in its segment's stripped text, and its stripped length."""
    w = Window.partitionBy(*SEG).orderBy("word_index")
    before = F.coalesce(F.sum(F.length("word")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.length("word") - F.length(F.regexp_replace("word", r"(?U)^\s+", ""))
    return (words.withColumn("_lead", lead)
            .withColumn("offset", before + F.col("_lead") - F.first("_lead").over(w))
            .withColumn("length", F.length(tx.strip("word"))).drop("_lead"))
