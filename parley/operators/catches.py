"""Misspelled names of known worlds: casts, votes, sound matches, gates and occurrences."""

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parley.functions import text as tx
from parley.functions.phonetic import code_rows, metaphone_codes, with_codes
from parley.operators.names import AT, MIN_NAME, Codes, bigrams, cleaned, flag_common
from parley.operators.scans import first_row
from parley.operators.skew import keyed_lookup
from parley.session import materialize

NAME_LINE = r"(?m)^\s*([A-Za-z][\w '.-]{1,30}?)\s*-+>\s*([A-Za-z][\w '.-]{1,30})\s*$"


def cast_lines(raw: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    """Names in a plain-line answer: bullets and articles off, odd lines dropped, first of each kept."""
    lines = raw.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "_l"))
    s = F.regexp_replace("_l", r"^[\s\-*.\d)]+", "")
    s = F.regexp_replace(tx.strip(s), r'^[",]+|[",]+$', "")
    lines = lines.select(*keys, "line_no", F.regexp_replace(s, r"^[Tt]he\s+", "").alias("name"))
    fine = lines.filter((F.col("name") != "") & (F.length("name") <= 40) & ~F.col("name").rlike(r"[^\x00-\x7f]")
                        & ~F.col("name").rlike(r"[:{}\[\]]")).withColumn("_key", F.lower("name"))
    return first_row(fine, [*keys, "_key"], [F.col("line_no")]).drop("_key")


def correction_cast(casts: DataFrame) -> DataFrame:
    """(world, form, name, cast_rank): groups before characters, one entry per cleaned form."""
    rank = F.struct(F.when(F.col("kind") == "groups", 0).otherwise(1).alias("k"), F.col("rank").alias("r"))
    forms = casts.withColumn("form", tx.clean("name")).withColumn("cast_rank", rank).filter("form <> ''")
    return first_row(forms.select("world", "form", "name", "cast_rank"), ["world", "form"], [F.col("cast_rank")])


def judge_lines(raw: DataFrame, keys: Sequence[str], text: str = "raw") -> DataFrame:
    """'wrong -> correct' lines of an answer: (keys, line_no, wrong, canonical, key), first per key."""
    wrongs = F.regexp_extract_all(text, F.lit(NAME_LINE), 1)
    rights = F.regexp_extract_all(text, F.lit(NAME_LINE), 2)
    pairs = raw.select(*keys, F.posexplode(F.arrays_zip(wrongs.alias("w"), rights.alias("r"))).alias("line_no", "_p"))
    pairs = pairs.select(*keys, "line_no", tx.strip(F.col("_p.w")).alias("wrong"), tx.strip(F.col("_p.r")).alias("canonical"))
    pairs = pairs.withColumn("key", tx.clean("wrong")).filter((F.col("key") != "") & (F.col("key") != tx.clean("canonical")))
    return first_row(pairs, [*keys, "key"], [F.col("line_no")])


def vote(catches: DataFrame, scope: Sequence[str], rounds: int, threshold: float = 0.4) -> DataFrame:
    """Wrong spellings caught in enough rounds, with the spelling most rounds proposed.

    ``catches``: scope, round, line_no, wrong, canonical. A spelling counts once per round; equal
    proposals are settled by the alphabet.
    """
    need = -(-int(round(threshold * rounds * 1e6)) // 10**6)
    keyed = catches.withColumn("key", tx.clean("wrong")).filter("key <> ''")
    once = first_row(keyed.select(*scope, "round", "key", "line_no", "wrong", "canonical"), [*scope, "round", "key"], [F.col("line_no")])
    per = once.groupBy(*scope, "key", "canonical").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("round", "wrong")).alias("_w"))
    return (per.groupBy(*scope, "key").agg(
        F.sum("_n").alias("vote_count"), F.min_by("canonical", F.struct(-F.col("_n"), F.col("canonical"))).alias("canonical"),
        F.min("_w").alias("_w"))
        .filter(F.col("vote_count") >= need)
        .select(*scope, "key", F.col("_w.wrong").alias("wrong"), "canonical", "vote_count", F.lit(rounds).alias("vote_rounds")))


def sound_match(forms: DataFrame, cast: DataFrame, scope: Sequence[str], codes: Codes = metaphone_codes) -> DataFrame:
    """Forms (scope, world, c) that sound like a cast name without being one: (scope, key, canonical).

    The form's first code with a cast name decides; a code belongs to the first name carrying it.
    """
    cast = materialize(cast)
    cast_codes = code_rows(with_codes(cast, "form", codes))
    owners = first_row(cast.join(cast_codes, "form").select("world", "code", "name", "cast_rank", "code_rank"),
                       ["world", "code"], [F.col("cast_rank"), F.col("code_rank")]).select("world", "code", F.col("name").alias("canonical"))
    long = materialize(forms.filter(F.length("c") >= MIN_NAME).select(*scope, "world", "c").distinct())
    wrong = long.join(cast.select("world", F.col("form").alias("c")), ["world", "c"], "left_anti")
    coded = keyed_lookup(wrong, code_rows(with_codes(long, "c", codes)), ["c"], list(scope))
    return (keyed_lookup(coded, owners, ["world", "code"], ["c"]).groupBy(*scope, "c")
            .agg(F.min_by("canonical", "code_rank").alias("canonical")).withColumnRenamed("c", "key"))


@F.pandas_udf(DoubleType())
def spelling_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two spellings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _deletions(code: Column, k: int) -> Column:
    """The code and every string left after deleting up to ``k`` of its letters."""
    out = F.array(code)
    for _ in range(k):
        shorter = F.transform(out, lambda x: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))),
            lambda i: F.concat(x.substr(F.lit(1), i - 1), F.substr(x, i + 1))))
        out = F.array_distinct(F.concat(out, F.flatten(shorter)))
    return out


def fuzzy_match(forms: DataFrame, cast: DataFrame, scope: Sequence[str], max_edits: int, min_ratio: float,
                codes: Codes = metaphone_codes) -> DataFrame:
    """Sound matches, and for the other forms the most similar name with a code ``max_edits`` away.

    Two codes within k edits share a string in their k-deletion sets, so candidate pairs come from
    an equi-join on those strings, never from all pairs; the edit distance then settles each pair.
    """
    cast = materialize(cast)
    exact = materialize(sound_match(forms, cast, scope, codes).withColumn("ratio", F.lit(None).cast("double")))
    long = forms.filter(F.length("c") >= MIN_NAME).select(*scope, "world", "c").distinct()
    rest = (long.join(cast.select("world", F.col("form").alias("c")), ["world", "c"], "left_anti")
            .join(exact.select(*scope, F.col("key").alias("c")), [*scope, "c"], "left_anti"))
    rest = materialize(rest)
    vocab = rest.select("world", "c").distinct()
    a = vocab.join(code_rows(with_codes(vocab, "c", codes)).select("c", "code"), "c").withColumn("_g", F.explode(_deletions(F.col("code"), max_edits)))
    b = (cast.join(code_rows(with_codes(cast, "form", codes)), "form")
         .select("world", "form", "name", "cast_rank", F.col("code").alias("code2"))
         .withColumn("_g", F.explode(_deletions(F.col("code2"), max_edits))))
    near = keyed_lookup(b, a, ["world", "_g"], ["form"]).filter(F.levenshtein("code", "code2", max_edits) >= 0)
    pairs = near.select("world", "c", "form", "name", "cast_rank").distinct().withColumn("ratio", spelling_ratio("c", "form"))
    best = pairs.filter(F.col("ratio") >= min_ratio).groupBy("world", "c").agg(
        F.min_by(F.struct("name", "ratio"), F.struct(-F.col("ratio"), F.col("cast_rank"))).alias("_m"))
    found = keyed_lookup(rest, best, ["world", "c"], ["c"]).select(*scope, F.col("c").alias("key"), F.col("_m.name").alias("canonical"), F.col("_m.ratio").alias("ratio"))
    return exact.unionByName(found)


def combine(judged: DataFrame, sounded: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Union of both kinds of catch by wrong spelling; a sound match's canonical wins."""
    j = judged.select(*scope, "key", F.lit(1).alias("_m"), "canonical", "vote_count", "vote_rounds")
    p = sounded.select(*scope, "key", F.lit(0).alias("_m"), "canonical")
    both = p.unionByName(j, allowMissingColumns=True)
    return both.groupBy(*scope, "key").agg(
        F.min_by("canonical", "_m").alias("canonical"), F.max("vote_count").alias("_v"),
        F.array_sort(F.collect_set(F.when(F.col("_m") == 0, "phonetic").otherwise("judge")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("methods"),
        F.min(F.when(F.col("_m") == 0, 1)).alias("_p")).select(
        *scope, "key", "canonical", "methods", F.when(F.col("_p").isNull(), F.col("_v")).alias("vote_count"))


def dictionary_gate(flags: DataFrame, singles: DataFrame, common: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Drop catches that are ordinary words.

    ``flags``: scope, flag_id, case, canonical, key (one row per wrong form). An ordinary word is in
    the word list (plural tolerated) and never a name in its story. A flag whose canonical and one
    of whose forms are ordinary goes whole; ordinary forms go one by one. Only case M9c is gated.
    """
    flags = materialize(flags)
    forms = flags.select(*scope, F.explode(F.array("key", tx.clean("canonical"))).alias("_f")).filter("_f <> ''").distinct()
    listed = flag_common(forms, common, "_f", True, "_c").filter("_c").drop("_c")
    ordinary = materialize(listed.join(singles.select(*scope, F.col("c").alias("_f")), [*scope, "_f"], "left_anti"))
    marked = flags.withColumn("_canon", tx.clean("canonical"))
    for form, name in (("key", "_wrong"), ("_canon", "_right")):
        hits = ordinary.withColumnRenamed("_f", form).withColumn(name, F.lit(True))
        marked = keyed_lookup(marked, hits, [*scope, form], ["flag_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    whole = marked.groupBy(*scope, "flag_id").agg(F.bool_or("_wrong").alias("_any"))
    both = keyed_lookup(marked, whole, [*scope, "flag_id"], ["key"])
    keep = (F.col("case") != "M9c") | ~(F.col("_wrong") | (F.col("_right") & F.col("_any")))
    return both.filter(keep).withColumn("gated_some", (F.col("case") == "M9c") & F.col("_any")).select(*flags.columns, "gated_some")


def shield(flags: DataFrame, protected: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Remove protected real names from inconsistency flags (case M9b) only."""
    p = protected.select(*scope, F.col("c").alias("key")).distinct().withColumn("_p", F.lit(True))
    return keyed_lookup(flags, p, [*scope, "key"], ["flag_id"], "left").filter("_p is null or case <> 'M9b'").drop("_p")


def verdict_flags(verdicts: DataFrame, surfaces: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Flags from card verdicts: (scope, flag_id, case, canonical, surface, key).

    ``verdicts``: scope, card_key, verdict, canonical; ``surfaces``: scope, card_key, surface,
    listed (the verdict named this spelling as wrong). Listed spellings are the wrong ones; without
    any, those that differ from the canonical; without any, all.
    """
    case = (F.when(F.col("verdict") == "canon_wrong", "M9c").when(F.col("verdict") == "inconsistent", "M9b")
            .when(F.col("verdict") == "substitution", "M9d-suspect"))
    named = verdicts.withColumn("case", case).filter("case is not null")
    rows = keyed_lookup(surfaces, named, [*scope, "card_key"], ["surface"]).withColumn("key", tx.clean("surface"))
    rows = rows.withColumn("_lvl", F.when(F.col("listed"), 0).when(F.col("key") != tx.clean("canonical"), 1).otherwise(2))
    best = rows.groupBy(*scope, "card_key").agg(F.min("_lvl").alias("_best"))
    kept = keyed_lookup(rows, best, [*scope, "card_key"], ["surface"]).filter("_lvl = _best")
    return kept.select(*scope, F.col("card_key").alias("flag_id"), "case", "canonical", "surface", "key").filter("case <> 'M9d-suspect'")


def expand(flags: DataFrame, words: DataFrame, scope: Sequence[str], codes: Codes = metaphone_codes) -> DataFrame:
    """One row per use of a wrong form (a word, or two words run together), once per place and case.

    ``confident`` tells whether the form sounds like the proposed spelling.
    """
    flags = materialize(flags)
    pairs = flags.select(F.col("key").alias("c"), tx.clean("canonical").alias("r")).distinct()
    coded = pairs.withColumn("_a", codes(F.col("c"))).withColumn("_b", codes(F.col("r")))
    sure = coded.select(F.col("c").alias("key"), F.col("r").alias("_r"), F.arrays_overlap("_a", "_b").alias("confident"))
    rated = materialize(keyed_lookup(flags.withColumn("_r", tx.clean("canonical")), sure, ["key", "_r"], list(scope)).drop("_r"))
    rest = [a for a in AT if a not in scope]
    single = cleaned(words).select(*scope, *rest, "word", F.lit(None).cast("string").alias("word2"), F.col("c").alias("key"), F.lit(0).alias("_two"))
    # cleaned forms hold letters alone, and so do two run together
    double = bigrams(words).select(*scope, *rest, "word", "word2", F.concat("c", "c2").alias("key"), F.lit(1).alias("_two"))
    uses = keyed_lookup(single.unionByName(double), rated, [*scope, "key"], AT)
    where = list(dict.fromkeys([*scope, *AT, "case"]))
    first = first_row(uses, where, [F.col("_two"), F.col("flag_id")]).drop("_two")
    return first.withColumn("token", F.concat_ws(" ", tx.strip("word"), tx.strip("word2"))).drop("word", "word2")


def canon_tier() -> Column:
    return F.when(F.col("confident"), "confident").when(F.coalesce("vote_count", F.lit(0)) >= 3, "best_guess").otherwise("low")


def group_catches(catches: DataFrame, scope: Sequence[str], form: str = "key", edge: str = r"^[\s.,?!]+|[\s.,?!]+$") -> DataFrame:
    """One row per (scope, heard form): first attributes, number of uses and usual surface."""
    place = F.struct("seg_pos", "word_index")
    shown = catches.withColumn("_s", F.regexp_replace("token", edge, ""))
    per = shown.groupBy(*scope, form, "_s").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_at"),
                                               F.min_by(F.struct("canonical", "confident"), place).alias("_f"))
    return per.groupBy(*scope, form).agg(
        F.sum("_n").alias("n_occurrences"), F.min_by("_s", F.struct(-F.col("_n"), F.col("_at"))).alias("heard"),
        F.min_by("_f", "_at").alias("_f")).select(*scope, form, "n_occurrences", "heard", F.col("_f.canonical").alias("suggestion"),
                                                 F.col("_f.confident").alias("confident"))


def classify(groups: DataFrame, blessed: DataFrame, form: str = "key") -> DataFrame:
    """Fate of each group: blessed spelling, sound-alike (both automatic) or a person's decision.

    ``blessed``: world, form, canonical, ordinal; the later entry of a form wins.
    """
    last = blessed.withColumn(form, tx.clean("form")).filter(F.col(form) != "").groupBy("world", form).agg(
        F.max_by("canonical", "ordinal").alias("_b"))
    g = keyed_lookup(groups, last, ["world", form], [form, "suggestion"], "left")
    known = F.col("_b").isNotNull()
    return (g.withColumn("action", F.when(known | F.col("confident"), "auto").otherwise("pending"))
            .withColumn("canonical", F.coalesce("_b", "suggestion"))
            .withColumn("method", F.when(known, "dictionary").when(F.col("confident"), "sound-alike").otherwise("judge")).drop("_b"))


def gate_decisions(candidates: DataFrame, reheard: DataFrame, cast: DataFrame, blessed: DataFrame, singles: DataFrame,
                   common: DataFrame, scope: Sequence[str], tolerance: int, lead: int, codes: Codes = metaphone_codes) -> DataFrame:
    """Decide each candidate word from what a second, primed hearing put there.

    ``candidates``: AT, scope, world, start, blind. ``reheard``: AT, word, offset (order breaks ties
    of distance). Words within ``tolerance`` of the expected offset count, nearest first; the first
    that is a cast spelling, a name of the recording or no common word is the target.
    """
    c = candidates.withColumn("blind_c", tx.clean("blind")).withColumn("expected", F.least(F.col("start"), F.lit(lead)))
    last = blessed.withColumn("blind_c", tx.clean("form")).filter("blind_c <> ''").groupBy("world", "blind_c").agg(
        F.max_by("canonical", "ordinal").alias("_b"))
    c = materialize(keyed_lookup(c, last, ["world", "blind_c"], AT, "left"))
    cast = materialize(cast)
    heard = reheard.withColumn("wc", tx.clean("word")).filter("wc <> ''")
    near = c.filter("_b is null").join(heard.select(*AT, "word", "wc", "offset"), AT).withColumn(
        "_far", F.abs(F.col("offset") - F.col("expected"))).filter(F.col("_far") <= tolerance)
    in_cast = cast.select("world", F.col("form").alias("wc"), F.col("name").alias("_exact"))
    named = singles.select("session_id", F.col("c").alias("wc")).distinct().withColumn("_single", F.lit(True))
    near = keyed_lookup(near, in_cast, ["world", "wc"], AT, "left")
    near = keyed_lookup(near, named, ["session_id", "wc"], AT, "left")
    near = flag_common(materialize(near), common, "wc", False, "_common")
    fit = near.filter(F.col("_exact").isNotNull() | F.col("_single") | ~F.col("_common"))
    target = first_row(fit.select(*AT, "_far", "offset", "word", "wc", "_exact"), AT, [F.col("_far"), F.col("offset"), F.col("word")])
    # the first cast name, in cast order, that shares a code with the target
    cast_codes = cast.join(code_rows(with_codes(cast, "form", codes)), "form").select("world", "code", "name", "cast_rank")
    owners = first_row(cast_codes, ["world", "code"], [F.col("cast_rank")])
    pairs = materialize(c.select(*AT, "world", "blind_c").join(target, AT).filter("wc <> blind_c"))
    vocab = code_rows(with_codes(pairs.filter("_exact is null"), "wc", codes))
    sound = keyed_lookup(keyed_lookup(pairs.filter("_exact is null").select("world", "wc").distinct(), vocab, ["wc"], ["wc"]),
                         owners, ["world", "code"], ["wc"]).groupBy("world", "wc").agg(F.min_by("name", "cast_rank").alias("_sound"))
    settled = keyed_lookup(pairs, sound, ["world", "wc"], AT, "left").withColumn("canonical", F.coalesce("_exact", "_sound")).filter("canonical is not null")
    settled = flag_common(settled, common, "blind_c", False, "_bc").select(
        *AT, F.col("word").alias("redecoded"), "canonical", F.when(F.col("_exact").isNotNull(), "exact").otherwise("dm").alias("how"),
        F.when(F.col("_bc"), "queued").otherwise("auto").alias("action"))
    direct = c.filter("_b is not null").select(*AT, F.col("blind").alias("redecoded"), F.col("_b").alias("canonical"),
                                                F.lit("dictionary").alias("how"), F.lit("auto").alias("action"))
    extra = [s for s in dict.fromkeys([*scope, "world", "blind", "start", "blind_c"]) if s not in AT]
    return settled.unionByName(direct).join(c.select(*AT, *extra), AT)


def group_decisions(decisions: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per (scope, heard form, action): first decision's canonical, uses, heard surface."""
    place = F.struct("seg_pos", "word_index")
    return decisions.groupBy(*scope, F.col("blind_c").alias("key"), "action").agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.min_by(F.struct("canonical", "how", "blind"), place).alias("_f"),
        F.min(place).alias("_at")).select(
        *scope, "key", "action", "n_occurrences", F.col("_f.canonical").alias("canonical"), F.col("_f.how").alias("how"),
        F.regexp_replace(F.col("_f.blind"), r"^[ .,?!]+|[ .,?!]+$", "").alias("heard"), F.col("_at.seg_pos").alias("first_seg"),
        F.col("_at.word_index").alias("first_word"))


def auto_corrections(groups: DataFrame, order: Sequence[str], scope: Sequence[str] = ("session_id",)) -> DataFrame:
    """(scope, transcribed, correct): one mapping per heard form, the first group's."""
    auto = groups.filter("action = 'auto' and key <> ''")
    return first_row(auto.select(*scope, "key", *order, "canonical"), [*scope, "key"], [F.col(o) for o in order]).select(
        *scope, F.col("key").alias("transcribed"), F.col("canonical").alias("correct"))


def group_occurrences(rows: DataFrame, scope: Sequence[str], form: str, text: str, more: Sequence[str] = ()) -> DataFrame:
    """The uses behind groups, one row each: (scope, key, more, AT, surface), edge punctuation off.

    Join to a group table by scope and key for the list a reader opens; a group may have any number.
    """
    rest = [a for a in AT if a not in scope]
    surface = F.regexp_replace(F.col(text), r"^[\s.,?!]+|[\s.,?!]+$", "")
    return rows.select(*scope, F.col(form).alias("key"), *more, *rest, surface.alias("surface"))
