"""Queries over vectors, profiles and identifications."""

from pyspark.sql import functions as F

from parley.functions import vectors as vec
from parley.operators import identity as idn
from parley.operators.filters import match_band
from parley.plans import bindings as b
from parley.plans.catalog import query

MEAN = """SELECT profile_id, list(m ORDER BY i) AS centroid FROM (SELECT profile_id, i, avg(x) AS m FROM (SELECT profile_id, unnest(vector) AS x, unnest(range(len(vector))) AS i FROM {src}) GROUP BY ALL) GROUP BY profile_id"""
# every other vector session (vec_id // 10) is a recording of its own
VEC = "SELECT vec_id, CAST(vec_id // 10 AS VARCHAR) AS session_id, CAST(vec_id % 10 AS VARCHAR) AS speaker_key, profile_id, vector FROM vectors"
BEST = """SELECT q.session_id, q.speaker_key, arg_max(c.profile_id, (round(list_cosine_similarity(q.vector, c.centroid), 12), -CAST(c.profile_id AS INTEGER))) AS profile_id,
    max(list_cosine_similarity(q.vector, c.centroid)) AS similarity FROM vs q, cen c GROUP BY ALL"""
IDENT = """SELECT session_id, speaker_key, CASE WHEN similarity >= 0.75 THEN 'identified' WHEN similarity >= 0.45 THEN 'suggested' ELSE 'unknown' END AS status,
    CASE WHEN similarity >= 0.45 THEN profile_id END AS profile_id, CASE WHEN similarity >= 0.45 THEN round(similarity, 4) END AS confidence FROM best"""
PARTS = dict(vs=VEC, cen=MEAN.format(src="vs"), best=BEST, ident=IDENT)
K = ["session_id", "speaker_key"]


def vs(spark, sf):
    v = b.vectors(spark, sf)
    return v.select("vec_id", F.floor(F.col("vec_id") / 10).cast("string").alias("session_id"), (F.col("vec_id") % 10).cast("string").alias("speaker_key"), "profile_id", "vector")


def profiles(spark, sf):
    return idn.centroids(vs(spark, sf)).withColumn("rank", F.col("profile_id").cast("int"))


def ident(spark, sf):
    return idn.identify(vs(spark, sf), profiles(spark, sf))


@query("centroids", b.with_ctes("vectors", "SELECT profile_id, array_to_string(list_transform(centroid, lambda x: printf('%.5f', x + 1e-12)), ',') AS centroid FROM cen", cen=MEAN.format(src="vectors")))
def centroids(spark, sf):
    c = idn.centroids(b.vectors(spark, sf))
    return c.select("profile_id", F.array_join(F.transform("centroid", lambda x: F.format_string("%.5f", x + 1e-12)), ",").alias("centroid"))


@query("cosine_best", b.with_ctes("vectors", "SELECT session_id, speaker_key, profile_id, round(similarity, 6) AS similarity FROM best", **PARTS))
def cosine_best(spark, sf):
    return idn.best_profiles(vs(spark, sf), profiles(spark, sf), K).withColumn("similarity", F.round("similarity", 6))


@query("identify_speakers", b.with_ctes("vectors", """SELECT i.*, CASE WHEN confidence IS NULL THEN 'grey' WHEN confidence >= 0.75 THEN 'green' WHEN confidence >= 0.60 THEN 'yellow' ELSE 'red' END AS band FROM ident i""", **PARTS))
def identify_speakers(spark, sf):
    return ident(spark, sf).withColumn("band", match_band("confidence"))


@query("identification_confusion", b.with_ctes("vectors", """SELECT v.profile_id AS gold, coalesce(i.profile_id, 'none') AS predicted, count(*) AS n FROM ident i JOIN vs v USING (session_id, speaker_key) GROUP BY ALL""", **PARTS))
def identification_confusion(spark, sf):
    gold = vs(spark, sf).select(*K, F.col("profile_id").alias("gold"))
    return ident(spark, sf).join(gold, K).groupBy("gold", F.coalesce("profile_id", F.lit("none")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


TURN = """SELECT CAST(vec_id // 40 AS VARCHAR) AS session_id, profile_id AS speaker_key, vec_id * 7 AS "start", vec_id * 7 + vec_id % 4 AS "end",
    vector FROM vectors"""


@query("speaker_vectors", b.with_ctes("vectors", """SELECT session_id, speaker_key, num_segments, total_duration, round(m[1] / nrm, 5) AS first_x, round(m[64] / nrm, 5) AS last_x FROM (SELECT session_id, speaker_key, list(a ORDER BY i) AS m, sqrt(sum(a * a)) AS nrm
    FROM (SELECT session_id, speaker_key, i, avg(x) AS a FROM (SELECT session_id, speaker_key, unnest(u) AS x, unnest(range(len(u))) AS i FROM un) GROUP BY ALL) GROUP BY ALL) JOIN
    (SELECT session_id, speaker_key, count(*) FILTER ("end" - "start" >= 1) AS num_segments, sum("end" - "start") AS total_duration FROM tv GROUP BY ALL) USING (session_id, speaker_key)""",
    tv=TURN, un="""SELECT session_id, speaker_key, list_transform(vector, lambda x: x / n) AS u FROM (SELECT *, sqrt(list_dot_product(vector, vector)) AS n FROM tv WHERE "end" - "start" >= 1)"""), bigint="total_duration")
def speaker_vectors(spark, sf):
    v = b.vectors(spark, sf)
    i = F.col("vec_id")
    t = v.select(F.floor(i / 40).cast("string").alias("session_id"), F.col("profile_id").alias("speaker_key"), (i * 7).alias("start"), (i * 7 + i % 4).alias("end"), "vector")
    s = idn.speaker_vectors(t, shortest=1)
    return s.select(*K, "num_segments", "total_duration", F.round(F.get("vector", F.lit(0)), 5).alias("first_x"), F.round(F.get("vector", F.lit(63)), 5).alias("last_x"))


@query("latest_matches", b.with_ctes("vectors", """SELECT profile_id, arg_max(session_id, (st, -o)) AS session_id, arg_max(confidence, (st, -o)) AS confidence FROM (SELECT *, CAST(session_id AS INTEGER) // 3 AS st, CAST(session_id AS INTEGER) * 10 + CAST(speaker_key AS INTEGER) AS o FROM ident)
    WHERE confidence IS NOT NULL GROUP BY profile_id""", **PARTS))
def latest_matches(spark, sf):
    return idn.latest_matches(stamped(spark, sf)).drop("identified_at")


def stamped(spark, sf):
    s = F.col("session_id").cast("int")
    return ident(spark, sf).withColumn("identified_at", F.floor(s / 3)).withColumn("ordinal", s * 10 + F.col("speaker_key").cast("int"))


ENROLLED = "SELECT profile_id, session_id, min(speaker_key) AS speaker_key FROM vs GROUP BY ALL"


@query("enrolments", b.with_ctes("vectors", ENROLLED, vs=VEC))
def enrolments(spark, sf):
    v = vs(spark, sf)
    return idn.enrol(v.filter("false"), v).select("profile_id", "session_id", "speaker_key")


ACT = """SELECT session_id, speaker_key, profile_id, CASE vec_id % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'variant' WHEN 2 THEN 'create' ELSE 'skip' END AS action FROM vs"""


def actions(spark, sf):
    m = F.col("vec_id") % 4
    return vs(spark, sf).select(*K, "profile_id", F.when(m == 0, "confirm").when(m == 1, "variant").when(m == 2, "create").otherwise("skip").alias("action"))


@query("profile_list", b.with_ctes("vectors", """SELECT p.profile_id, coalesce(n_enrolled, 0) AS n_enrolled, coalesce(n_variants, 0) AS n_variants, last_seen FROM (SELECT DISTINCT profile_id FROM vs) p
    LEFT JOIN (SELECT profile_id, count(DISTINCT session_id) AS n_enrolled, max(session_id) AS last_seen FROM act WHERE action IN ('confirm', 'create') GROUP BY ALL) e USING (profile_id)
    LEFT JOIN (SELECT profile_id, count(DISTINCT session_id) AS n_variants FROM act WHERE action = 'variant' GROUP BY ALL) w USING (profile_id)""", vs=VEC, act=ACT))
def profile_list(spark, sf):
    v = vs(spark, sf)
    none = v.filter("false")
    pv, variants = idn.confirm(actions(spark, sf), v, none, none)
    out = idn.profile_list(v.select("profile_id").distinct(), pv, variants, stamped(spark, sf))
    return out.select("profile_id", "n_enrolled", "n_variants", "last_seen")


@query("confirmed_speakers", b.with_ctes("vectors", """SELECT i.session_id, i.speaker_key, i.status, i.profile_id, a.action IS NOT NULL AND a.action <> 'skip' AS confirmed, CASE WHEN a.action <> 'skip' THEN a.profile_id END AS confirmed_profile_id,
    CASE WHEN a.action <> 'skip' THEN a.action END AS action FROM ident i LEFT JOIN act a USING (session_id, speaker_key)""", **PARTS, act=ACT))
def confirmed_speakers(spark, sf):
    return idn.overlay_confirmed(ident(spark, sf), actions(spark, sf)).drop("confidence")


NEWCEN = "SELECT * FROM (" + MEAN.format(src="(SELECT v.profile_id, vector FROM vs v JOIN act a USING (session_id, speaker_key) WHERE action IN ('confirm', 'create') QUALIFY row_number() OVER (PARTITION BY v.profile_id, session_id ORDER BY speaker_key) = 1)") + ")"


@query("reidentified_speakers", b.with_ctes("vectors", """SELECT i.*, a.action IS NOT NULL AND a.action <> 'skip' AS confirmed, CASE WHEN a.action <> 'skip' THEN a.action END AS action
    FROM ident i LEFT JOIN act a USING (session_id, speaker_key)""", vs=VEC, act=ACT, cen=NEWCEN, best=BEST, ident=IDENT))
def reidentified_speakers(spark, sf):
    v = vs(spark, sf)
    none = v.filter("false")
    enrolled, _ = idn.confirm(actions(spark, sf), v, none, none)
    ranks = v.select("profile_id", F.col("profile_id").cast("int").alias("rank")).distinct()
    return idn.reidentify(v, enrolled, ranks, actions(spark, sf)).drop("confirmed_profile_id")


@query("profile_detail", b.with_ctes("vectors", """SELECT e.profile_id, e.session_id, e.speaker_key, vec_id % 5 AS num_segments, vec_id * 3 AS total_duration, vec_id * 7 AS sample_start, vec_id * 7 + 4 AS sample_end
    FROM enr e JOIN vs v USING (session_id, speaker_key)""", vs=VEC, enr=ENROLLED))
def profile_detail(spark, sf):
    v, i = vs(spark, sf), F.col("vec_id")
    facts = v.select(*K, (i % 5).alias("num_segments"), (i * 3).alias("total_duration"))
    samples = v.select(*K, (i * 7).alias("start"), (i * 7 + 4).alias("end"))
    return idn.profile_detail(idn.enrol(v.filter("false"), v), facts, samples)


@query("deleted_profiles", b.with_ctes("vectors", """SELECT session_id, speaker_key, CASE WHEN CAST(profile_id AS INTEGER) < 3 THEN 'unknown' ELSE status END AS status, CASE WHEN CAST(profile_id AS INTEGER) >= 3 THEN profile_id END AS profile_id FROM ident""", **PARTS))
def deleted_profiles(spark, sf):
    p = profiles(spark, sf)
    _, cleared = idn.delete_profiles(p, ident(spark, sf), p.filter("rank < 3"))
    return cleared.select(*K, "status", "profile_id")


@query("removed_enrolments", b.with_ctes("vectors", "SELECT profile_id, session_id, speaker_key FROM vs WHERE CAST(session_id AS INTEGER) >= 5", vs=VEC))
def removed_enrolments(spark, sf):
    v = vs(spark, sf)
    return idn.remove_enrolments(v, v.filter("cast(session_id as int) < 5")).select("profile_id", *K)


@query("centroids_after_removal", b.with_ctes("vectors", "SELECT profile_id, array_to_string(list_transform(centroid, lambda x: printf('%.5f', x + 1e-12)), ',') AS centroid FROM cen",
    vs=VEC, left_over="SELECT * FROM vs WHERE CAST(session_id AS INTEGER) >= 5", cen=MEAN.format(src="left_over")))
def centroids_after_removal(spark, sf):
    """Every profile's centroid once the first recordings' enrolments are gone."""
    v = vs(spark, sf)
    c = idn.centroids(idn.remove_enrolments(v, v.filter("cast(session_id as int) < 5")))
    return c.select("profile_id", F.array_join(F.transform("centroid", lambda x: F.format_string("%.5f", x + 1e-12)), ",").alias("centroid"))


@query("edited_profiles", b.with_ctes("vectors", """SELECT coalesce(p.profile_id, e.profile_id) AS profile_id, coalesce(e.name, p.name) AS name, coalesce(p.role, 'guest') AS role FROM (SELECT DISTINCT profile_id, 'P' || profile_id AS name, 'child' AS role FROM vectors) p
    FULL JOIN (SELECT DISTINCT 'n' || profile_id AS profile_id, 'N' AS name FROM vectors UNION SELECT DISTINCT profile_id, 'Q' FROM vectors WHERE profile_id > '5') e ON p.profile_id = e.profile_id"""))
def edited_profiles(spark, sf):
    ids = b.vectors(spark, sf).select("profile_id").distinct()
    base = ids.select("profile_id", F.concat(F.lit("P"), "profile_id").alias("name"), F.lit("child").alias("role"), F.lit(0).alias("updated"))
    new = ids.select(F.concat(F.lit("n"), "profile_id").alias("profile_id"), F.lit("N").alias("name"), F.lit("guest").alias("role"), F.lit(1).alias("updated"))
    renamed = ids.filter("profile_id > '5'").select("profile_id", F.lit("Q").alias("name"), F.lit(None).cast("string").alias("role"), F.lit(1).alias("updated"))
    return idn.edit_profiles(base, new.unionByName(renamed)).drop("updated")


@query("representative_turns", b.with_ctes("turns", """SELECT session_id, speaker, arg_min("start", (a, bb, "start")) AS start_us FROM (SELECT t.*, CASE WHEN t."end" - t."start" >= 14400000000 THEN 0 ELSE 1 END AS a,
    CASE WHEN t."end" - t."start" >= 14400000000 THEN abs(t."start" - ms) WHEN t."start" = ms THEN 0 ELSE 1 END AS bb FROM turns t JOIN (SELECT session_id, speaker, min("start") AS ms FROM cum WHERE c * 2 >= tot GROUP BY ALL) m USING (session_id, speaker)) GROUP BY ALL""",
    cum="""SELECT *, sum("end" - "start") OVER (PARTITION BY session_id, speaker ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS c, sum("end" - "start") OVER (PARTITION BY session_id, speaker) AS tot FROM turns"""))
def representative_turns(spark, sf):
    return idn.representative_turns(b.turns(spark, sf), b.TIME_BLOCK, long=14_400_000_000).select("session_id", "speaker", F.col("start").alias("start_us"))


@query("clip_bounds", b.with_ctes("words", """SELECT w.session_id, w.seg_pos, w.word_index, CASE WHEN s."end" - s."start" <= 12000 THEN s."start" ELSE w."start" END AS clip_start,
    CASE WHEN s."end" - s."start" <= 12000 THEN s."end" ELSE coalesce(w."end", w."start" + 4000) END AS clip_end FROM words w JOIN segments s ON w.session_id = s.session_id AND w.seg_pos = s.seg_pos"""))
def clip_bounds(spark, sf):
    s = b.segments(spark, sf).select("session_id", "seg_pos", F.col("start").alias("ss"), F.col("end").alias("se"))
    w = b.words(spark, sf).join(s, ["session_id", "seg_pos"])
    clip = idn.clip_bounds(F.col("ss"), F.col("se"), F.col("start"), F.col("end"), 1000)
    return w.select("session_id", "seg_pos", "word_index", clip["start"].alias("clip_start"), clip["end"].alias("clip_end"))
