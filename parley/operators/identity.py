"""Speaker vectors, voice profiles, identification and enrolment."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import vectors as vec
from parley.operators.scans import RunSum, block_of, scan
from parley.operators.skew import keyed_lookup
from parley.session import staged

IDENTIFIED, SUGGESTED = 0.75, 0.45
#: Profiles that others are packed around, profiles of a pack, tasks for a pack's speakers, what rounding may add to an angle's bound.
PIVOTS, PACK_SIZE, SPREAD, SLACK = 16, 1024, 8, 1e-6


def centroids(profile_vectors: DataFrame, key: str = "profile_id") -> DataFrame:
    """Element-wise mean of each profile's enrolled vectors."""
    return vec.mean_vector(profile_vectors, [key], "vector", "centroid")


def speaker_vectors(turn_vectors: DataFrame, keys: Sequence[str] = ("session_id", "speaker_key"), shortest=0.5) -> DataFrame:
    """One unit vector per speaker from their turns' vectors.

    Short turns and non-finite vectors are left out of the mean but their time counts.
    """
    keys = list(keys)
    length = F.col("end") - F.col("start")
    usable = turn_vectors.filter((length >= F.lit(shortest)) & vec.is_finite(F.col("vector")))
    means = vec.mean_vector(usable.withColumn("vector", vec.unit(F.col("vector"))), keys, "vector", "_mean")
    sizes = turn_vectors.groupBy(*keys).agg(
        F.sum(length).alias("total_duration"),
        F.count_if((length >= F.lit(shortest)) & vec.is_finite(F.col("vector"))).alias("num_segments"))
    return means.join(sizes, keys).select(*keys, vec.unit(F.col("_mean")).alias("vector"), "num_segments", "total_duration")


def _angle(a: Column, b: Column) -> Column:
    """Angle between unit vectors; a right one where either is zero."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.dot(a, b))))


def profile_packs(profiles: DataFrame, pivots: int = PIVOTS, size: int = PACK_SIZE) -> tuple[DataFrame, list[list[float]]]:
    """(_k, _chunk, _r, _ps): profiles by nearest pivot, in packs of about ``size``; and the pivots.

    Pivots are ``pivots`` of the profiles, drawn by a hash. ``_r`` is the largest angle between a
    pack's pivot and its profiles: no profile of the pack is closer to a vector than the vector's
    angle to the pivot less ``_r``. A pack with a zero centroid has no such bound.
    """
    usable = staged(profiles.filter("centroid is not null").select("profile_id", "rank", vec.unit(F.col("centroid")).alias("centroid")))
    drawn = usable.filter(vec.norm(F.col("centroid")) > 0).orderBy(F.xxhash64("profile_id"), "profile_id").limit(pivots)
    chosen = [list(r["centroid"]) for r in drawn.select("centroid").collect()]
    near = usable.withColumn("_n", _nearest(F.col("centroid"), chosen)).select("*", "_n.*").drop("_n")
    radius = F.when(vec.norm(F.col("centroid")) > 0, F.col("_a")).otherwise(F.lit(math.pi))
    counts = usable.count()
    dealt = near.withColumn("_chunk", F.pmod(F.xxhash64("profile_id"), F.lit(max(1, -(-counts // size)))).cast("int"))
    packed = dealt.groupBy("_k", "_chunk").agg(F.max(radius).alias("_r"), F.collect_list(F.struct("profile_id", "rank", "centroid")).alias("_ps"))
    return staged(packed), chosen


def _nearest(v: Column, pivots: list[list[float]]) -> Column:
    """Number of the nearest pivot and the angle to it; pivot 0 at a right angle where there are none."""
    if not pivots:
        return F.struct(F.lit(0).alias("_k"), F.lit(math.pi / 2).alias("_a"))
    near = F.array_min(F.array(*[F.struct(_angle(v, _literal(p)).alias("a"), F.lit(k).alias("k")) for k, p in enumerate(pivots)]))
    return F.struct(near["k"].alias("_k"), near["a"].alias("_a"))


def _literal(p: list[float]) -> Column:
    return F.array(*map(F.lit, p))


def nearest_profiles(speakers: DataFrame, profiles: DataFrame, ids: Sequence[str], pivots: int = PIVOTS, size: int = PACK_SIZE,
                     spread: int = SPREAD) -> DataFrame:
    """(ids, profile_id, similarity, n_scored): each speaker's most similar profile; ties go to the lesser rank.

    A speaker first meets the packs of its nearest pivot. Of the others it meets only those whose
    bound (the triangle inequality over angles) reaches the best similarity found, so the answer is
    that of all pairs; ``n_scored`` counts the pairs that were scored. Packs have a bounded number of
    profiles, and a pack's speakers are spread over ``spread`` tasks.
    """
    ids = list(ids)
    packed, chosen = profile_packs(profiles, pivots, size)
    vectors = staged(speakers.select(*ids, vec.unit(F.col("vector")).alias("vector")))
    radii = packed.select("_k", "_chunk", "_r")

    def score(meetings: DataFrame) -> DataFrame:
        scored = keyed_lookup(meetings, packed.select("_k", "_chunk", "_ps"), ["_k", "_chunk"], ids, spread=spread)
        return scored.select(*ids, F.size("_ps").alias("_n"), F.array_max(F.transform("_ps", lambda p: F.struct(
            vec.dot(F.col("vector"), p["centroid"]).alias("s"), (-p["rank"]).alias("r"), p["profile_id"].alias("id")))).alias("_b"))

    homes = vectors.withColumn("_n", _nearest(F.col("vector"), chosen)).select(*ids, "vector", "_n._k")
    first = staged(score(homes.join(radii.select("_k", "_chunk"), "_k")))
    so_far = first.groupBy(*ids).agg(F.max("_b.s").alias("_s"))
    angles = F.array(*[F.struct(F.lit(k).alias("_k"), _angle(F.col("vector"), _literal(p)).alias("_a")) for k, p in enumerate(chosen)]) if chosen \
        else F.array(F.struct(F.lit(0).alias("_k"), F.lit(math.pi / 2).alias("_a")))
    others = (homes.withColumnRenamed("_k", "_home").withColumn("_o", F.explode(angles)).select(*ids, "_home", "_o.*").filter("_k <> _home")
              .join(so_far, ids, "left").join(radii, "_k"))
    bound = F.cos(F.greatest(F.lit(0.0), F.col("_a") - F.col("_r")))
    hopeful = others.filter(F.col("_s").isNull() | (bound >= F.col("_s") - F.lit(SLACK))).select(*ids, "_k", "_chunk")
    both = first.unionByName(score(hopeful.join(vectors, ids)))
    return both.groupBy(*ids).agg(F.max("_b").alias("_b"), F.sum("_n").alias("n_scored")).select(
        *ids, F.col("_b.id").alias("profile_id"), F.col("_b.s").alias("similarity"), "n_scored")


def best_profiles(speakers: DataFrame, profiles: DataFrame, ids: Sequence[str], pivots: int = PIVOTS) -> DataFrame:
    """Each speaker's most similar profile: (ids, profile_id, similarity); ties go to the lesser rank.

    ``profiles``: profile_id, rank, centroid. Exact, without scoring all pairs (``nearest_profiles``).
    """
    return nearest_profiles(speakers, profiles, ids, pivots).drop("n_scored")


def identify(speakers: DataFrame, profiles: DataFrame, ids: Sequence[str] = ("session_id", "speaker_key")) -> DataFrame:
    """Status, profile and confidence of each speaker; unknown speakers carry neither."""
    best = speakers.select(*ids).join(best_profiles(speakers, profiles, ids), list(ids), "left")
    s = F.col("similarity")
    status = F.when(s >= IDENTIFIED, "identified").when(s >= SUGGESTED, "suggested").otherwise("unknown")
    known = F.col("status") != "unknown"
    return best.withColumn("status", status).select(
        *ids, "status", F.when(known, F.col("profile_id")).alias("profile_id"), F.when(known, F.round("similarity", 4)).alias("confidence"))


def latest_matches(identifications: DataFrame) -> DataFrame:
    """Each profile's most recent match with a confidence; equal times go to the first listed."""
    rank = F.struct(F.col("identified_at"), -F.col("ordinal"))
    return (identifications.filter("confidence is not null and profile_id is not null").groupBy("profile_id")
            .agg(F.max_by(F.struct("session_id", "confidence", "identified_at"), rank).alias("_m"))
            .select("profile_id", "_m.session_id", "_m.confidence", "_m.identified_at"))


def enrol(profile_vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors with new enrolments added, one per (profile, session)."""
    keys = ["profile_id", "session_id"]
    new = fresh.join(profile_vectors.select(*keys), keys, "left_anti").groupBy(*keys).agg(
        F.min_by(F.struct("speaker_key", "vector"), "speaker_key").alias("_v")).select(*keys, "_v.speaker_key", "_v.vector")
    return profile_vectors.select(*keys, "speaker_key", "vector").unionByName(new)


def confirm(actions: DataFrame, speakers: DataFrame, profile_vectors: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile_vectors, variants) after a person's decisions.

    ``actions``: session_id, speaker_key, action, profile_id. 'confirm', 'reassign' and 'create'
    enrol the speaker's vector (a created profile brings its new id); 'variant' stores it aside.
    """
    named = actions.join(speakers.select("session_id", "speaker_key", "vector"), ["session_id", "speaker_key"])
    added = named.filter(F.col("action").isin("confirm", "reassign", "create")).select("profile_id", "session_id", "speaker_key", "vector")
    aside = named.filter("action = 'variant'").select("profile_id", "session_id", "speaker_key", "vector")
    return enrol(profile_vectors, added), enrol(variants, aside)


def overlay_confirmed(identifications: DataFrame, actions: DataFrame) -> DataFrame:
    """Identifications with a person's decision, its kind included, beside the computed one."""
    done = actions.filter(F.col("action") != "skip").select("session_id", "speaker_key", F.lit(True).alias("confirmed"), "action", F.col("profile_id").alias("confirmed_profile_id"))
    return identifications.join(done, ["session_id", "speaker_key"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def reidentify(speakers: DataFrame, profile_vectors: DataFrame, ranks: DataFrame, actions: DataFrame) -> DataFrame:
    """Identifications after a person's decisions: speakers against the centroids of all enrolled vectors, decisions beside.

    ``profile_vectors`` are those that ``confirm`` returned; ``ranks``: profile_id, rank for ties.
    """
    fresh = centroids(profile_vectors).join(ranks, "profile_id")
    return overlay_confirmed(identify(speakers, fresh), actions)


def profile_list(profiles: DataFrame, profile_vectors: DataFrame, variants: DataFrame, identifications: DataFrame) -> DataFrame:
    """Profiles with enrolment and variant counts, last session and latest match."""
    n = profile_vectors.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_enrolled"), F.max("session_id").alias("last_seen"))
    v = variants.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_variants"))
    m = latest_matches(identifications).select("profile_id", F.col("session_id").alias("match_session"), F.col("confidence").alias("match_confidence"))
    out = profiles.join(n, "profile_id", "left").join(v, "profile_id", "left").join(m, "profile_id", "left")
    return out.na.fill(0, ["n_enrolled", "n_variants"])


def profile_detail(profile_vectors: DataFrame, speakers: DataFrame, samples: DataFrame) -> DataFrame:
    """Enrolments of each profile with the speaker's turn count, duration and sample clip in that session.

    ``samples``: session_id, speaker_key, start, end of a representative turn.
    """
    keys = ["session_id", "speaker_key"]
    facts = speakers.select(*keys, "num_segments", "total_duration")
    clips = samples.select(*keys, F.col("start").alias("sample_start"), F.col("end").alias("sample_end"))
    return profile_vectors.select("profile_id", *keys).join(facts, keys, "left").join(clips, keys, "left")


def edit_profiles(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Profiles created or changed: ``edits`` has profile_id, name, role, updated (null keeps the old value)."""
    e = edits.select("profile_id", F.col("name").alias("_n"), F.col("role").alias("_r"), F.col("updated").alias("_u"))
    return profiles.join(e, "profile_id", "full_outer").select(
        "profile_id", F.coalesce("_n", "name").alias("name"), F.coalesce("_r", "role").alias("role"), F.coalesce("_u", "updated").alias("updated"))


def delete_profiles(profiles: DataFrame, identifications: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles without the deleted ones, and identifications that named them made unknown."""
    g = gone.select("profile_id").distinct()
    marked = identifications.join(g.withColumn("_g", F.lit(True)), "profile_id", "left")
    cleared = marked.select(*[(F.when(F.col("_g"), F.lit("unknown")).otherwise(F.col(c)) if c == "status" else
                               F.when(F.col("_g").isNull(), F.col(c)) if c in ("profile_id", "confidence") else F.col(c)).alias(c)
                              for c in identifications.columns])
    return profiles.join(g, "profile_id", "left_anti"), cleared


def remove_enrolments(profile_vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """Vectors without the listed (profile, session) enrolments; centroids are recomputed from these."""
    return profile_vectors.join(gone.select("profile_id", "session_id").distinct(), ["profile_id", "session_id"], "left_anti")


def representative_turns(turns: DataFrame, block: int, keys: Sequence[str] = ("session_id", "speaker"), long=3) -> DataFrame:
    """A typical turn per speaker: around the middle of their speech, a long one when there is one."""
    keys = list(keys)
    t = turns.withColumn("_len", F.col("end") - F.col("start"))
    t = scan(t, keys, ["start", "end"], block_of("start", block), _cum=RunSum(F.col("_len")))
    total = t.groupBy(*keys).agg(F.sum("_len").alias("_total"))
    mid = (keyed_lookup(t, total, keys, ["start", "end"]).filter(F.col("_cum") * 2 >= F.col("_total"))
           .groupBy(*keys).agg(F.min_by(F.struct("start", "end"), F.struct("start", "end")).alias("_mid")))
    near = keyed_lookup(t, mid, keys, ["start", "end"])
    rank = F.struct(F.when(F.col("_len") >= F.lit(long), 0).otherwise(1).alias("a"),
                    F.when(F.col("_len") >= F.lit(long), F.abs(F.col("start") - F.col("_mid.start"))).otherwise(
                        F.when(F.col("start") == F.col("_mid.start"), 0).otherwise(1)).alias("b"), F.col("start").alias("c"))
    return near.groupBy(*keys).agg(F.min_by(F.struct("start", "end"), rank).alias("_p")).select(*keys, "_p.start", "_p.end")


def clip_bounds(seg_start: Column, seg_end: Column, word_start: Column, word_end: Column, per_second: int = 1) -> Column:
    """(start, end) of the sound to play: a segment of up to 12 s, else the word, else 4 s from it."""
    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), b.alias("end"))
    return (F.when(seg_end - seg_start <= 12 * per_second, span(seg_start, seg_end))
            .when(word_start.isNotNull() & word_end.isNotNull(), span(word_start, word_end))
            .when(seg_start.isNotNull() & seg_end.isNotNull() & word_start.isNotNull(),
                  span(word_start, F.least(word_start + 4 * per_second, seg_end))))
