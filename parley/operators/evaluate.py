"""Scoring predictions against answer keys."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.functions.phonetic import code_rows, with_codes
from parley.operators.asof import bracket
from parley.operators.intervals import overlap_join
from parley.operators.scans import RunSum, block_of, first_row, scan
from parley.operators.skew import keyed_lookup
from parley.session import materialize


def confusion(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Counts of gold class by predicted class; predictions outside the key are 'phantom'."""
    both = gold.join(predicted, list(keys), "full_outer")
    cells = both.select(F.coalesce("gold", F.lit("phantom")).alias("gold"), F.coalesce("predicted", F.lit("none")).alias("predicted"))
    return cells.groupBy("gold").pivot("predicted", list(classes)).count().na.fill(0)


def precision_recall(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Hits, misses and false alarms of two key sets, with precision and recall (null on zero)."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, list(keys), "full_outer").na.fill(0, ["_g", "_p"])
    out = both.groupBy(*by).agg(F.sum(F.col("_g") * F.col("_p")).alias("hits"), F.sum("_g").alias("n_gold"), F.sum("_p").alias("n_predicted"))
    return out.withColumn("precision", F.try_divide("hits", "n_predicted")).withColumn("recall", F.try_divide("hits", "n_gold"))


def gold_class(category: Column, cleaned: Column, true_spelling: Column, share_code: Column) -> Column:
    """Class of an answer-key item from its category and spellings."""
    true = tx.clean(F.coalesce(true_spelling, F.lit("")))
    same = (true == "") | (true == F.replace(cleaned, F.lit(" "), F.lit("")))
    return (F.when(F.coalesce(category, F.lit("")) == "", "unjudged").when(category.isin("not-a-name", "place-other"), "no-error")
            .when(category == "roster", "M9a").when(category.isin("tv-canon", "improvised") & same, "no-error")
            .when(category == "tv-canon", "M9c").when(category == "improvised", F.when(share_code, "M9b").otherwise("M9d")).otherwise("unjudged"))


def policy_sweep(flags: DataFrame, gold: DataFrame, keys: Sequence[str], policies: dict[str, Sequence[str]]) -> DataFrame:
    """Precision and recall for each policy (name -> tiers shown)."""
    rules = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.lit(t) for t in tiers]).alias("t")) for n, tiers in policies.items()])
    shown = flags.withColumn("_r", F.explode(rules)).filter(F.array_contains("_r.t", F.col("tier"))).withColumn("policy", F.col("_r.n"))
    key = gold.select(*keys).distinct().withColumn("policy", F.explode(F.array(*[F.lit(n) for n in policies])))
    return precision_recall(key, shown, [*keys, "policy"], ["policy"])


def ensemble(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two predictors; where both speak the first wins."""
    return first_row(first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1))), keys, [F.col("_o")]).drop("_o")


def match_stories(truth: DataFrame, predicted: DataFrame, width: int) -> DataFrame:
    """One-to-one matches of true and predicted stories, longest truth first, by greatest overlap.

    A true story can be settled as soon as no longer one still unmatched overlaps its best
    prediction, so each round settles many at once; the result equals the one-by-one walk.
    Columns: session_id, story_idx / pred_idx, start_pos, end_pos. Overlaps are inclusive.
    """
    t = truth.select("session_id", F.col("story_idx").alias("gi"), "start_pos", "end_pos")
    p = predicted.select("session_id", F.col("pred_idx").alias("pj"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"))
    length = F.col("end_pos") - F.col("start_pos")
    pairs = overlap_join(t, p, ["session_id"], width, "start_pos", "end_pos", closed=True).select(
        "session_id", "gi", "pj", F.struct(-length, F.col("gi")).alias("prio"),
        (F.least("end_pos", "r_end") - F.greatest("start_pos", "r_start") + 1).alias("overlap"))
    open_pairs = materialize(pairs)
    done = None
    while True:
        best = open_pairs.groupBy("session_id", "gi").agg(F.max_by("pj", F.struct("overlap", -F.col("pj"))).alias("pj"), F.max("prio").alias("prio"))
        first = open_pairs.groupBy("session_id", "pj").agg(F.min("prio").alias("_first"))
        settled = materialize(best.join(first, ["session_id", "pj"]).filter("prio = _first").select("session_id", "gi", "pj"))
        if settled.isEmpty():
            break
        done = settled if done is None else done.unionByName(settled)
        open_pairs = materialize(open_pairs.join(settled.select("session_id", "gi"), ["session_id", "gi"], "left_anti")
                                 .join(settled.select("session_id", "pj"), ["session_id", "pj"], "left_anti"))
    matched = (done if done is not None else settled)
    return matched.select("session_id", F.col("gi").alias("story_idx"), F.col("pj").alias("pred_idx"))


def story_scores(truth: DataFrame, predicted: DataFrame, width: int, tol: int = 2) -> DataFrame:
    """Matched stories with IoU and whether each boundary is within ``tol`` positions."""
    m = match_stories(truth, predicted, width)
    t = truth.select("session_id", "story_idx", "start_pos", "end_pos")
    p = predicted.select("session_id", "pred_idx", F.col("start_pos").alias("ps"), F.col("end_pos").alias("pe"))
    j = m.join(t, ["session_id", "story_idx"]).join(p, ["session_id", "pred_idx"])
    inter = F.least("end_pos", "pe") - F.greatest("start_pos", "ps") + 1
    union = (F.col("end_pos") - F.col("start_pos") + 1) + (F.col("pe") - F.col("ps") + 1) - inter
    return j.select("session_id", "story_idx", "pred_idx", (inter / union).alias("iou"),
                    (F.abs(F.col("start_pos") - F.col("ps")) <= tol).alias("start_ok"), (F.abs(F.col("end_pos") - F.col("pe")) <= tol).alias("end_ok"))


def split_report(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Story counts per session: exact, over-split of a single story, under-split."""
    t = truth.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_truth"))
    p = predicted.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_predicted"))
    b = t.join(p, "session_id", "left").na.fill(0)
    return b.withColumn("exact", F.col("n_truth") == F.col("n_predicted")).withColumn(
        "over_split", (F.col("n_truth") == 1) & (F.col("n_predicted") > 1)).withColumn("under_split", F.col("n_predicted") < F.col("n_truth"))


def boundary_recall(boundaries: DataFrame, candidates: DataFrame, block: int, tol: int = 2) -> DataFrame:
    """Distance of each true boundary (session_id, boundary_id, pos) to the nearest candidate."""
    c = candidates.select("session_id", F.col("pos").alias("cand")).distinct().withColumn("_t", F.col("cand"))
    b = boundaries.select("session_id", "boundary_id", F.col("pos").cast("long").alias("pos"))
    both = bracket(b, c, ["session_id"], ["cand"], "_t", block, "pos", "pos", "_t")
    d = F.least(F.col("pos") - F.col("prev_cand"), F.col("next_cand") - F.col("pos"))
    return both.select("session_id", "boundary_id", "pos", d.alias("distance"), F.coalesce(d <= tol, F.lit(False)).alias("found"))


def world_outcomes(stories: DataFrame, predictions: DataFrame) -> DataFrame:
    """correct, missed_canon, wrong_world or false_world for each (candidate, story).

    ``stories``: id, bucket, difficulty, world_gold, world_aliases. Names match when either
    normalised form holds the other; aliases under three letters are ignored.
    """
    said = tx.normalize_world("world_pred")
    names = F.filter(F.transform(F.concat(F.array("world_gold"), F.coalesce("world_aliases", F.array().cast("array<string>"))), tx.normalize_world), lambda a: F.length(a) >= 3)
    j = predictions.join(stories, "id").withColumn("_p", said).withColumn("_n", names)
    right = (F.col("_p") != "") & F.exists("_n", lambda a: F.contains(F.col("_p"), a) | F.contains(a, F.col("_p")))
    none = tx.claims_none("world_pred")
    real = F.col("bucket").isin("canon", "hybrid")
    out = (F.when(real & right, "correct").when(real & none, "missed_canon").when(real, "wrong_world").when(none, "correct").otherwise("false_world"))
    return j.withColumn("outcome", out).select("candidate", "id", "bucket", "difficulty", "world_gold", "outcome")


def world_report(outcomes: DataFrame) -> DataFrame:
    """Accuracy overall and by bucket, difficulty and world; ``facet`` tells which."""
    facets = F.array(*[F.struct(F.lit(n).alias("f"), v.alias("v")) for n, v in (
        ("all", F.lit("all")), ("bucket", F.col("bucket")), ("difficulty", F.col("difficulty")), ("world", F.col("world_gold")))])
    rows = outcomes.select("candidate", "outcome", F.explode(facets).alias("_x")).filter(F.col("_x.v") != "")
    return rows.groupBy("candidate", F.col("_x.f").alias("facet"), F.col("_x.v").alias("value")).agg(
        F.count_if(F.col("outcome") == "correct").alias("n_correct"), F.count(F.lit(1)).alias("n"))


def planted_recall(planted: DataFrame, flagged: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per scope: planted misspellings found, and flags that hit none of them.

    ``planted``: scope, heard; ``flagged``: scope, flag_id, cleaned.
    """
    want = planted.withColumn("_id", F.col("heard")).select(*scope, "_id", F.explode(tx.heard_forms("heard")).alias("form"))
    have = flagged.select(*scope, "flag_id", F.explode(tx.forms("cleaned")).alias("form"))
    found = want.join(have.select(*scope, "form").distinct(), [*scope, "form"], "left_semi").select(*scope, "_id").distinct()
    true = have.join(want.select(*scope, "form").distinct(), [*scope, "form"], "left_semi").select(*scope, "flag_id").distinct()
    counts = (planted.select(*scope, "heard").distinct().select(*scope, F.lit(1).alias("planted"), F.lit(0).alias("found"), F.lit(0).alias("flags"), F.lit(0).alias("true_flags"))
              .unionByName(found.select(*scope, F.lit(0).alias("planted"), F.lit(1).alias("found"), F.lit(0).alias("flags"), F.lit(0).alias("true_flags")))
              .unionByName(flagged.select(*scope, "flag_id").distinct().select(*scope, F.lit(0).alias("planted"), F.lit(0).alias("found"), F.lit(1).alias("flags"), F.lit(0).alias("true_flags")))
              .unionByName(true.select(*scope, F.lit(0).alias("planted"), F.lit(0).alias("found"), F.lit(0).alias("flags"), F.lit(1).alias("true_flags"))))
    return counts.groupBy(*scope).agg(F.sum("planted").alias("n_planted"), F.sum("found").alias("n_found"), (F.sum("flags") - F.sum("true_flags")).alias("n_false"))


def key_scores(key: DataFrame, words: DataFrame, codes, tol: int, width: int, block: int, unknowable: Sequence[str] = ()) -> DataFrame:
    """Outcome of each key note (session_id, note_id, at, answer): exact, dm, miss or unknowable.

    A word starting within ``tol`` of the note may match; without any, the nearest word may. Exact
    beats sound-alike. ``words``: session_id, word_id, word, start.
    """
    from parley.functions.phonetic import with_codes
    w = words.select("session_id", "word_id", tx.clean("word").alias("c"), "start")
    k = key.select("session_id", "note_id", "at", "answer", tx.clean("answer").alias("a"))
    spans = k.withColumn("_lo", F.col("at") - tol).withColumn("_hi", F.col("at") + tol)
    points = w.withColumn("_s", F.col("start")).withColumn("_e", F.col("start"))
    near = overlap_join(spans, points, ["session_id"], width, "_lo", "_hi", "_s", "_e", closed=True).select("session_id", "note_id", "a", "c")
    lone = k.join(near.select("session_id", "note_id").distinct(), ["session_id", "note_id"], "left_anti")
    both = bracket(lone, w.withColumn("t", F.col("start")), ["session_id"], ["c", "t"], "word_id", block, "at", "at")
    before = F.col("next_t").isNull() | (F.col("at") - F.col("prev_t") <= F.col("next_t") - F.col("at"))
    far = both.select("session_id", "note_id", "a", F.when(F.col("prev_t").isNotNull() & before, F.col("prev_c")).otherwise(F.col("next_c")).alias("c"))
    seen = materialize(near.unionByName(far).filter("c <> '' and a <> ''").distinct())
    pairs = seen.select("a", "c").filter("a <> c").distinct()
    ca = with_codes(pairs, "a", codes, "_ca")
    cc = with_codes(pairs, "c", codes, "_cc")
    alike = pairs.join(ca, "a").join(cc, "c").filter(F.arrays_overlap("_ca", "_cc")).select("a", "c").withColumn("_dm", F.lit(True))
    rated = keyed_lookup(seen, alike, ["a", "c"], ["session_id", "note_id"], "left")
    rank = rated.groupBy("session_id", "note_id").agg(F.min(F.when(F.col("a") == F.col("c"), 0).when(F.col("_dm"), 1)).alias("_r"))
    out = k.join(rank, ["session_id", "note_id"], "left")
    match = (F.when(F.col("answer").isin(list(unknowable)), "unknowable") if unknowable else F.when(F.lit(False), "")).when(F.col("_r") == 0, "exact").when(F.col("_r") == 1, "dm").otherwise("miss")
    return out.select("session_id", "note_id", "answer", match.alias("match"))


def key_summary(scores: DataFrame) -> DataFrame:
    """Tallies and recall of key outcomes per session."""
    hits = F.count_if(F.col("match").isin("exact", "dm"))
    n = F.count_if(F.col("match") != "unknowable")
    return scores.groupBy("session_id").agg(*[F.count_if(F.col("match") == m).alias(m) for m in ("exact", "dm", "miss", "unknowable")],
                                            F.round(F.coalesce(F.try_divide(hits, n), F.lit(0.0)), 3).alias("recall"))


def ordinary_words(words: DataFrame, cast: DataFrame, codes) -> DataFrame:
    """Words of at least four cleaned letters that share no sound code with a cast name (column ``name``)."""
    w = words.withColumn("c", tx.clean("word")).filter(F.length("c") >= 4)
    forms = code_rows(with_codes(w, "c", codes)).select("c", "code")
    names = code_rows(with_codes(cast.select(tx.clean("name").alias("name")), "name", codes)).select("code").distinct()
    alike = forms.join(names, "code", "left_semi").select("c").distinct()
    return w.join(alike, "c", "left_anti").drop("c")


def controls(words: DataFrame, key: DataFrame, n: int, min_gap: int, width: int, block: int) -> DataFrame:
    """``n`` words per session, evenly spread, at least ``min_gap`` from every key note; give it ``ordinary_words``."""
    w = words.withColumn("_lo", F.col("start")).withColumn("_hi", F.col("start"))
    k = key.select("session_id", (F.col("at") - min_gap + 1).alias("_s"), (F.col("at") + min_gap - 1).alias("_e")).distinct()
    close = overlap_join(w, k, ["session_id"], width, "_lo", "_hi", "_s", "_e", closed=True).select("session_id", "word_id").distinct()
    free = materialize(words.join(close, ["session_id", "word_id"], "left_anti"))
    numbered = scan(free, ["session_id"], ["start", "word_id"], block_of("start", block), _i=RunSum(F.lit(1).cast("long"), inclusive=False))
    total = free.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    both = keyed_lookup(numbered, total, ["session_id"], ["word_id"])
    # row i is floor(k * N / n) for some k exactly when a multiple of N / n falls in [i, i + 1)
    steps = F.floor(((F.col("_i") + 1) * n - 1) / F.col("_n")) - F.floor((F.col("_i") * n - 1) / F.col("_n"))
    return both.filter((F.col("_n") <= n) | (steps > 0)).drop("_i", "_n")


def cluster_purity(clusters: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per cluster, per true name): clusters holding several names are merged, names over several clusters split.

    ``clusters``: session_id, cluster_id, c; ``truth``: session_id, c, true_name.
    """
    j = truth.join(clusters, ["session_id", "c"], "left")
    per_cluster = j.filter("cluster_id is not null").groupBy("session_id", "cluster_id").agg(F.countDistinct("true_name").alias("n_names"))
    per_cluster = per_cluster.withColumn("verdict", F.when(F.col("n_names") > 1, "merged").otherwise("clean"))
    mixed = per_cluster.select("session_id", "cluster_id", (F.col("n_names") > 1).alias("_m"))
    named = keyed_lookup(j, mixed, ["session_id", "cluster_id"], ["c"], "left")
    per_name = named.groupBy("session_id", "true_name").agg(
        F.countDistinct("c").alias("n_spellings"), F.countDistinct("cluster_id").alias("n_clusters"),
        F.count_if(F.col("cluster_id").isNull()).alias("n_loose"), F.bool_or(F.coalesce("_m", F.lit(False))).alias("_mixed"))
    verdict = (F.when(F.col("n_spellings") == 1, "single").when((F.col("n_clusters") == 1) & (F.col("n_loose") == 0),
                                                                 F.when(F.col("_mixed"), "merged").otherwise("clean")).otherwise("split"))
    return per_cluster, per_name.withColumn("verdict", verdict).drop("_mixed")


def normaliser_scores(key: DataFrame, decisions: DataFrame, at: Sequence[str]) -> DataFrame:
    """Outcomes of correction decisions on the key: automatic or waiting, right or wrong, or unchanged."""
    j = key.join(decisions.select(*at, "action", "canonical"), list(at), "left")
    right = F.lower("canonical") == F.lower("answer")
    out = F.when(F.col("action").isNull(), "unchanged").otherwise(F.concat(
        F.when(F.col("action") == "auto", "auto").otherwise("pending"), F.when(right, "_right").otherwise("_wrong")))
    return j.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def silent_swaps(words: DataFrame, truth: DataFrame, overrides: DataFrame, flagged: DataFrame, primary) -> DataFrame:
    """Uses of a written form that sounds unlike its true name and that no detector flags.

    ``truth``: session_id, c, true_name; ``overrides``: session_id, seg_pos, word_index, true_name wins.
    """
    at = ["session_id", "seg_pos", "word_index"]
    silent = truth.join(flagged.select("session_id", "c").distinct(), ["session_id", "c"], "left_anti")
    uses = keyed_lookup(words.select(*at, "c"), silent, ["session_id", "c"], at)
    o = overrides.select(*at, F.col("true_name").alias("_o"))
    uses = uses.join(o, at, "left").withColumn("true_name", F.coalesce("_o", "true_name")).filter("true_name <> ''")
    per = uses.groupBy("session_id", "c", "true_name").agg(F.count(F.lit(1)).alias("n"))
    return per.filter(~primary(F.col("c")).eqNullSafe(primary(tx.clean("true_name"))))


def majority_verdicts(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdict most runs gave (earliest run on ties) and whether all agreed: keys, run, verdict."""
    per = votes.groupBy(*keys, "verdict").agg(F.count(F.lit(1)).alias("_n"), F.min("run").alias("_at"))
    return per.groupBy(*keys).agg(F.min_by("verdict", F.struct(-F.col("_n"), F.col("_at"))).alias("majority"), (F.count(F.lit(1)) == 1).alias("stable"))


def filter_scorecard(majorities: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names kept, false alarms dropped, stability, precision and recall of a keep-or-drop filter."""
    j = majorities.join(truth, list(keys))
    name, kept = F.col("is_name"), F.col("majority") == "NAME"
    s = j.agg(F.count_if(name).alias("n_names"), F.count_if(name & kept).alias("names_kept"), F.count_if(~name).alias("n_false"),
              F.count_if(~name & ~kept).alias("false_dropped"), F.count_if("stable").alias("n_stable"), F.count_if(kept).alias("n_kept"))
    return s.withColumn("precision", F.round(F.try_divide("names_kept", "n_kept"), 6)).withColumn("recall", F.round(F.try_divide("names_kept", "n_names"), 6))


def forced_rates(clips: DataFrame, cast: DataFrame, codes) -> DataFrame:
    """Share of control clips in which a cast name appears, per mode: mode, clip_id, word."""
    from parley.functions.phonetic import code_rows, with_codes
    spelled = materialize(clips.select("word").distinct()).withColumn("c", tx.clean("word"))
    cast_codes = code_rows(with_codes(cast, "form", codes)).select("code").distinct()
    alike = code_rows(with_codes(spelled, "c", codes)).join(cast_codes, "code", "left_semi").select("c").distinct()
    hits = spelled.join(alike, "c", "left_semi").select("word").withColumn("_h", F.lit(True))
    per = keyed_lookup(clips, hits, ["word"], ["clip_id"], "left").groupBy("mode", "clip_id").agg(F.bool_or(F.coalesce("_h", F.lit(False))).alias("_f"))
    return per.groupBy("mode").agg(F.count(F.lit(1)).alias("n_clips"), F.count_if("_f").alias("n_forced"),
                                   F.round(F.avg(F.col("_f").cast("int")), 3).alias("rate"))


def net_forcing(rates: DataFrame, primed: str, plain: str) -> DataFrame:
    """One row: clips of both modes, forced ones of each, and what is left to the priming (net, and as a share of its clips)."""
    def of(mode: str, col: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("mode") == mode, F.col(col))), F.lit(0)).cast("long")
    sums = rates.agg(of(primed, "n_clips").alias("n_primed"), of(plain, "n_clips").alias("n_plain"),
                     of(primed, "n_forced").alias("forced_primed"), of(plain, "n_forced").alias("forced_plain"))
    net = F.col("forced_primed") - F.col("forced_plain")
    return sums.withColumn("net", net).withColumn("net_rate", F.coalesce(F.round(F.try_divide("net", "n_primed"), 3), F.lit(0.0)))
