"""Queries over flags and verdicts. Each event stands for one flag."""

from pyspark.sql import functions as F

from parley.operators import overlays as ov
from parley.plans import bindings as b
from parley.plans.catalog import query

FLAG = r"""SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS flag_id, CASE event_type WHEN 'view' THEN 'm9a' WHEN 'click' THEN 'm9b' ELSE 'm9c' END AS detector_id, 'k' || k AS token, 'k' || k AS cleaned,
    'c' || k % 10 AS canonical, CASE WHEN event_type = 'click' THEN 'g' || k % 7 END AS cluster_id, value > 50 AS confident, CAST(k % 6 AS BIGINT) AS vote_count
    FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events WHERE event_type <> 'signup')"""
VERD = r"""SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN k % 2 = 0 THEN 'not_canon' ELSE 'correct' END AS type, CASE WHEN k % 2 = 0 THEN 'c' || k % 10 END AS name, CASE WHEN k % 2 = 1 THEN 'k' || k END AS cleaned
    FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events WHERE event_type = 'signup')"""
APPLIED = """SELECT * FROM flag f WHERE NOT (detector_id = 'm9c' AND EXISTS (SELECT 1 FROM verd v WHERE v.session_id = f.session_id AND v.type = 'not_canon' AND v.name = f.canonical))
    AND NOT (detector_id IN ('m9b', 'm9c') AND EXISTS (SELECT 1 FROM verd v WHERE v.session_id = f.session_id AND v.type = 'correct' AND v.cleaned = f.cleaned))"""
TIERED = "SELECT *, CASE WHEN detector_id = 'm9c' THEN CASE WHEN confident THEN 'confident' WHEN vote_count >= 3 THEN 'best_guess' ELSE 'low' END END AS tier FROM applied"
SHOWN = """SELECT * FROM tiered t WHERE NOT (detector_id = 'm9b' AND EXISTS (SELECT 1 FROM tiered m JOIN tiered c ON m.session_id = c.session_id AND m.cleaned = c.cleaned WHERE m.session_id = t.session_id AND m.detector_id = 'm9b'
    AND m.cluster_id = t.cluster_id AND c.detector_id = 'm9c' AND c.tier <> 'low'))"""
PARTS = dict(flag=FLAG, verd=VERD, applied=APPLIED, tiered=TIERED, shown=SHOWN)


def sql(body):
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in PARTS.items()) + " " + body


def events(spark, sf):
    return b.table(spark, sf, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))


def flags(spark, sf):
    k, t = F.col("k"), F.col("event_type")
    return events(spark, sf).filter("event_type <> 'signup'").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("flag_id"), F.when(t == "view", "m9a").when(t == "click", "m9b").otherwise("m9c").alias("detector_id"),
        F.concat(F.lit("k"), k).alias("token"), F.concat(F.lit("k"), k).alias("cleaned"), F.concat(F.lit("c"), k % 10).alias("canonical"),
        F.when(t == "click", F.concat(F.lit("g"), k % 7)).alias("cluster_id"), (F.col("value") > 50).alias("confident"), (k % 6).cast("long").alias("vote_count"))


def verdicts(spark, sf):
    k = F.col("k")
    return events(spark, sf).filter("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("session_id"), F.when(k % 2 == 0, "not_canon").otherwise("correct").alias("type"),
        F.when(k % 2 == 0, F.concat(F.lit("c"), k % 10)).alias("name"), F.when(k % 2 == 1, F.concat(F.lit("k"), k)).alias("cleaned")).distinct()


@query("applied_verdicts", sql("SELECT session_id, flag_id, detector_id FROM applied"))
def applied_verdicts(spark, sf):
    return ov.apply_verdicts(flags(spark, sf), verdicts(spark, sf)).select("session_id", "flag_id", "detector_id")


@query("visible_spellings", sql("""SELECT session_id, cluster_id, token AS spelling FROM (SELECT DISTINCT session_id, cluster_id, token FROM flag WHERE detector_id = 'm9b') s WHERE (session_id, token) NOT IN (SELECT session_id, cleaned FROM verd WHERE type = 'correct')"""))
def visible_spellings(spark, sf):
    s = flags(spark, sf).filter("detector_id = 'm9b'").select("session_id", "cluster_id", F.col("token").alias("spelling")).distinct()
    return ov.visible_spellings(s, verdicts(spark, sf))


REVIEW = "SELECT DISTINCT session_id, canonical AS name, cleaned FROM flag WHERE detector_id = 'm9c' AND vote_count < 5"


@query("verdict_staleness", sql(f"""SELECT v.session_id, v.name, (NOT ends_with(v.name, '4') AND n IS NOT NULL AND n IS DISTINCT FROM r) AS stale FROM (SELECT DISTINCT session_id, name FROM verd WHERE type = 'not_canon') v
    LEFT JOIN (SELECT session_id, canonical AS name, list_sort(list_distinct(list(cleaned))) AS n FROM flag WHERE detector_id = 'm9c' GROUP BY ALL) c USING (session_id, name)
    LEFT JOIN (SELECT session_id, name, list_sort(list(cleaned)) AS r FROM ({REVIEW}) GROUP BY ALL) q USING (session_id, name)"""))
def verdict_staleness(spark, sf):
    f = flags(spark, sf)
    reviewed = f.filter("detector_id = 'm9c' and vote_count < 5").select("session_id", F.col("canonical").alias("name"), "cleaned").distinct()
    return ov.verdict_staleness(f, verdicts(spark, sf).withColumn("has_review", ~F.col("name").endswith("4")), reviewed)


@query("canon_tiers", sql("SELECT session_id, tier, count(*) AS n, count(*) FILTER (tier <> 'low') AS n_shown FROM tiered WHERE tier IS NOT NULL GROUP BY ALL"))
def canon_tiers(spark, sf):
    t = ov.with_tiers(ov.apply_verdicts(flags(spark, sf), verdicts(spark, sf))).filter("tier is not null")
    return t.groupBy("session_id", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") != "low").alias("n_shown"))


@query("shown_flags", sql("SELECT session_id, flag_id, detector_id, tier FROM shown"))
def shown_flags(spark, sf):
    return ov.overlaid(flags(spark, sf), verdicts(spark, sf)).select("session_id", "flag_id", "detector_id", "tier")


ROLL = "SELECT session_id, detector_id, count(*) FILTER (detector_id <> 'm9c' OR tier <> 'low') AS n_flags FROM shown GROUP BY ALL"


@query("detection_rollup", sql(f"""SELECT r.*, coalesce(stale, false) AS stale FROM (SELECT * FROM ({ROLL}) UNION ALL SELECT 'all', detector_id, sum(n_flags) FROM ({ROLL}) GROUP BY detector_id) r
    LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS session_id, bool_or(value > 300) AS stale FROM events GROUP BY user_id) s USING (session_id)"""), bigint="n_flags")
def detection_rollup(spark, sf):
    stale = b.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("value") > 300).alias("stale"))
    return ov.rollup(ov.overlaid(flags(spark, sf), verdicts(spark, sf)), stale)


@query("flag_groups", sql("""SELECT session_id, detector_id, CASE detector_id WHEN 'm9b' THEN cluster_id ELSE canonical END AS group_key, count(*) AS n, count(DISTINCT token) AS n_spellings FROM shown GROUP BY ALL"""))
def flag_groups(spark, sf):
    return ov.flag_groups(ov.overlaid(flags(spark, sf), verdicts(spark, sf)))


@query("flag_spellings", sql("""SELECT session_id, detector_id, CASE detector_id WHEN 'm9b' THEN cluster_id ELSE canonical END AS group_key, token AS spelling, count(*) AS n FROM shown GROUP BY ALL"""))
def flag_spellings(spark, sf):
    return ov.flag_spellings(ov.overlaid(flags(spark, sf), verdicts(spark, sf)))


@query("toggled_verdicts", sql(r"""SELECT * FROM (SELECT * FROM verd EXCEPT SELECT * FROM sent UNION ALL (SELECT * FROM sent EXCEPT SELECT * FROM verd))""").replace("shown AS", r"""sent AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id,
    'correct' AS type, CAST(NULL AS VARCHAR) AS name, 'k' || regexp_extract(props, '(\d+)', 1) AS cleaned FROM events WHERE event_type = 'view'), shown AS"""))
def toggled_verdicts(spark, sf):
    sent = events(spark, sf).filter("event_type = 'view'").select(F.col("user_id").cast("string").alias("session_id"), F.lit("correct").alias("type"),
                                                                  F.lit(None).cast("string").alias("name"), F.concat(F.lit("k"), "k").alias("cleaned")).distinct()
    return ov.toggle_verdicts(verdicts(spark, sf), sent)


@query("flag_lines", b.with_ctes("segments", """SELECT f.session_id, f.flag_id, f.seg_pos, trim(s.text) AS segment_text, s."start" AS segment_start, s."end" AS segment_end, s.speaker_label AS segment_speaker FROM f LEFT JOIN segments s ON f.session_id = s.session_id AND f.seg_pos = s.seg_pos""",
    f="SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS flag_id, CAST(event_id % 10 AS INTEGER) AS seg_pos FROM events"))
def flag_lines(spark, sf):
    f = b.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("flag_id"), (F.col("event_id") % 10).cast("int").alias("seg_pos"))
    return ov.flag_lines(f, b.segments(spark, sf))
