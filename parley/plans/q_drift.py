"""Queries over loudness and drifted timestamps. Frames are half hours of an event line."""

from pyspark.sql import functions as F

from parley.operators import drift as dr
from parley.operators import speakers
from parley.plans import bindings as b
from parley.plans.catalog import query
from parley.session import materialize

FRAME = 1_800_000_000
FRAMES = """SELECT session_id, frame_idx, 20 * log10(greatest(sqrt(p), 1e-10)) AS db FROM (SELECT w.session_id, w."start" // 1800000000 AS frame_idx, avg((e.value / 500) * (e.value / 500)) AS p
    FROM timed_words w JOIN events e ON w.event_id = e.event_id GROUP BY ALL)"""
FLOOR = 'SELECT session_id, quantile_cont(db, 0.2) AS "floor", quantile_cont(db, 0.2) + 12 AS threshold FROM frames GROUP BY session_id'
LAST = "SELECT session_id, max(frame_idx) AS lst FROM frames GROUP BY session_id"


def _window(lo: str, hi: str) -> str:
    return f"""(SELECT max(db) FROM frames f WHERE f.session_id = w.session_id AND f.frame_idx BETWEEN greatest(0, least(CAST(trunc({lo} / 1800000000) AS BIGINT), lst))
        AND greatest(greatest(0, least(CAST(trunc({lo} / 1800000000) AS BIGINT), lst)), greatest(0, least(CAST(trunc({hi} / 1800000000) AS BIGINT), lst))))"""


LOUD = f"""SELECT w.session_id, w.event_id, w.word, w."start", w."end", {_window('w."start"', 'w."start"')} AS loud_db, {_window('(w."start" - 3600000000)', '(w."start" + 3600000000)')} AS near_db
    FROM timed_words w JOIN lst l ON w.session_id = l.session_id WHERE (w.session_id, w."start" // 86400000000) NOT IN (SELECT session_id, d FROM folded)"""
FOLDED = """SELECT s.session_id, d FROM (SELECT session_id, "start" // 86400000000 AS d, arg_min(word, event_id) AS text FROM timed_words GROUP BY ALL) s
    JOIN (SELECT session_id, min("start" // 86400000000) AS d0, min(word) AS filler FROM timed_words GROUP BY ALL) f ON s.session_id = f.session_id AND d BETWEEN d0 + 1 AND d0 + 12 AND trim(text) = filler"""
TOTAL = """SELECT w.session_id, w.event_id, CASE WHEN any_value(w."end" - w."start") > 0 THEN least(coalesce(sum(least(w."end", t."end") - greatest(w."start", t."start")) FILTER (t.speaker IS NOT NULL), 0) / any_value(w."end" - w."start"), 1.0) ELSE 0.0 END AS total FROM timed_words w
    LEFT JOIN (SELECT * FROM turns WHERE speaker = 'view') t ON w.session_id = t.session_id AND w."start" < t."end" AND t."start" < w."end" GROUP BY w.session_id, w.event_id"""
CLASS = """SELECT *, CASE WHEN loud_db >= threshold THEN 'ok' WHEN total < 0.1 AND near_db >= threshold AND coded THEN 'drifted_coded' WHEN total < 0.1 AND near_db >= threshold THEN 'drifted' WHEN total < 0.1 THEN 'isolated' ELSE 'quiet_ambiguous' END AS category,
    round(CASE WHEN loud_db >= threshold THEN 0 WHEN total < 0.1 AND near_db >= threshold THEN 0.6 + 0.4 * q WHEN total < 0.1 THEN 0.4 + 0.2 * q ELSE 0.3 + 0.2 * q END, 3) AS score FROM
    (SELECT l.*, total, threshold, l."end" - l."start" > 200000000000 AS coded, greatest(0.0, least(1.0, (threshold - loud_db) / 15.0)) AS q FROM loud l JOIN tot USING (session_id, event_id) JOIN flr f ON l.session_id = f.session_id)"""
PARTS = dict(frames=FRAMES, flr=FLOOR, lst=LAST, folded=FOLDED, loud=LOUD, tot=TOTAL, cls=CLASS)


def frames(spark, sf):
    v = b.table(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("x"))
    return dr.loudness_frames(b.timed_words(spark, sf).join(v, "event_id"), F.floor(F.col("start") / FRAME))


def classified(spark, sf):
    w = b.timed_words(spark, sf).withColumn("seg_pos", F.floor(F.col("start") / 86_400_000_000))
    segments = w.groupBy("session_id", "seg_pos").agg(F.min_by("word", "event_id").alias("text"))
    days = w.groupBy("session_id").agg(F.min("seg_pos").alias("_d"), F.min("word").alias("filler"))
    stretches = days.select("session_id", (F.col("_d") + 1).alias("lo"), (F.col("_d") + 12).alias("hi"), "filler")
    w = dr.without_filler_loops(w, segments, stretches, 16)
    f = materialize(frames(spark, sf))
    points = w.select("session_id", "event_id", "start", F.col("start").alias("end"))
    loud = dr.window_loudness(points, f, ["event_id"], FRAME, 16)
    near = dr.window_loudness(points.withColumn("start", F.col("start") - 2 * FRAME).withColumn("end", F.col("end") + 2 * FRAME), f, ["event_id"], FRAME, 16, "near_db")
    total = speakers.total_coverage(w, b.turns(spark, sf).filter("speaker = 'view'"), ["session_id"], ["event_id"], b.BUCKET, "total")
    keys = ["session_id", "event_id"]
    j = w.join(loud, keys).join(near, keys).join(total, keys).join(dr.noise_floor(f), "session_id")
    codes = F.when(F.col("end") - F.col("start") > 200_000_000_000, F.array(F.lit("M2"))).otherwise(F.array().cast("array<string>"))
    return dr.classify_drift(j.withColumn("other_codes", codes))


@query("loudness_frames", b.with_ctes("timed_words", "SELECT session_id, frame_idx, round(db, 6) AS db FROM frames", frames=FRAMES))
def loudness_frames(spark, sf):
    return frames(spark, sf).withColumn("db", F.round("db", 6))


@query("noise_floor", b.with_ctes("timed_words", 'SELECT session_id, round("floor", 6) AS "floor", round(threshold, 6) AS threshold FROM flr', frames=FRAMES, flr=FLOOR))
def noise_floor(spark, sf):
    f = dr.noise_floor(frames(spark, sf))
    return f.select("session_id", F.round("floor", 6).alias("floor"), F.round("threshold", 6).alias("threshold"))


@query("timestamp_drift", b.with_ctes("turns", "SELECT session_id, event_id, round(loud_db, 4) AS loud_db, round(total, 6) AS total, category, score FROM cls", **PARTS))
def timestamp_drift(spark, sf):
    return classified(spark, sf).select("session_id", "event_id", F.round("loud_db", 4).alias("loud_db"), F.round("total", 6).alias("total"), "category", "score")


@query("drift_tally", b.with_ctes("turns", """SELECT c.*, coalesce(s1, 0) AS segments_1, coalesce(s2, 0) AS segments_2, coalesce(s3, 0) AS segments_3, coalesce(s4, 0) AS segments_4plus FROM (SELECT session_id, count(*) FILTER (category = 'ok') AS ok, count(*) FILTER (category = 'drifted') AS drifted,
    count(*) FILTER (category = 'drifted_coded') AS drifted_coded, count(*) FILTER (category = 'isolated') AS isolated, count(*) FILTER (category = 'quiet_ambiguous') AS quiet_ambiguous FROM cls GROUP BY session_id) c LEFT JOIN
    (SELECT session_id, count(*) FILTER (n = 1) AS s1, count(*) FILTER (n = 2) AS s2, count(*) FILTER (n = 3) AS s3, count(*) FILTER (n >= 4) AS s4 FROM (SELECT session_id, "start" // 86400000000 AS d, count(*) AS n FROM cls WHERE category = 'drifted' GROUP BY ALL) GROUP BY session_id) USING (session_id)""", **PARTS))
def drift_tally(spark, sf):
    return dr.drift_tally(classified(spark, sf))


@query("drift_check_list", b.with_ctes("turns", """SELECT session_id, event_id, score FROM cls WHERE category = 'drifted' ORDER BY score DESC, session_id, "start" // 86400000000, event_id LIMIT 100""", **PARTS))
def drift_check_list(spark, sf):
    return dr.check_list(classified(spark, sf)).select("session_id", "event_id", "score")


GAPS = """SELECT doc_id, (n_chars % 100) / 100.0 AS no_speech_prob, n_chars % 7 AS n_words, [CASE WHEN quality = 0 THEN 'M8' WHEN toxic = 1 THEN 'M3' ELSE 'NotA' END] AS codes FROM labels JOIN documents USING (doc_id)"""


@query("gap_code_agreement", f"""SELECT CASE WHEN codes[1] = 'M8' THEN 'M8' ELSE 'speech' END AS expected, CASE WHEN no_speech_prob >= 0.9 OR n_words = 0 THEN 'M8' ELSE 'speech' END AS suggestion, count(*) AS n FROM ({GAPS}) GROUP BY ALL""")
def gap_code_agreement(spark, sf):
    d = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id")
    g = d.select(((F.col("n_chars") % 100) / 100.0).alias("no_speech_prob"), (F.col("n_chars") % 7).alias("n_words"),
                 F.array(F.when(F.col("quality") == 0, "M8").when(F.col("toxic") == 1, "M3").otherwise("NotA")).alias("codes"))
    return dr.gap_agreement(dr.gap_suggestion(g))
