"""Queries over words, turns and gaps."""

from pyspark.sql import functions as F

from parley.operators import gaps as gp
from parley.operators import intervals as iv
from parley.operators import runs, speakers
from parley.operators.asof import bracket
from parley.operators.scans import block_of
from parley.plans import bindings as b
from parley.plans.catalog import query
from parley.session import staged

S = ["session_id"]
J1_SQL = """SELECT w.session_id, w.event_id, t.speaker, sum(least(w."end", t."end") - greatest(w."start", t."start")) AS ov,
    min(t."start") AS first_turn FROM timed_words w JOIN turns t ON w.session_id = t.session_id
    AND w."start" < t."end" AND t."start" < w."end" GROUP BY ALL"""


def turn_table(spark, sf):
    return b.turns(spark, sf)


@query("utterances", b.with_ctes("timed_words", """SELECT session_id, max(speaker_label) AS speaker_label, min("start") AS start_us,
    arg_max("end", ("start", event_id)) AS end_us, count(*) AS n_words, string_agg(word, ' ' ORDER BY "start", event_id) AS text
    FROM runs GROUP BY session_id, run""", marked="""SELECT *, CASE WHEN speaker_label IS NOT NULL AND
      lag(speaker_label) OVER (PARTITION BY session_id ORDER BY "start", event_id) = speaker_label THEN 0 ELSE 1 END AS isnew FROM timed_words""",
    runs="""SELECT *, sum(isnew) OVER (PARTITION BY session_id ORDER BY "start", event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked"""))
def utterances(spark, sf):
    u = runs.utterances(b.timed_words(spark, sf), S, ["start", "event_id"], b.time_block())
    return u.select("session_id", "speaker_label", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n_words", "text")


@query("top_sessions", b.with_ctes("words", """SELECT session_id, count(*) AS n_segments, sum(n) AS n_words,
    count(DISTINCT speaker_label) AS n_speakers FROM dom GROUP BY session_id""",
    cnt="SELECT session_id, seg_pos, speaker_label, count(*) AS n, min(word_index) AS f FROM words GROUP BY ALL",
    dom="""SELECT session_id, seg_pos, arg_max(speaker_label, (n, -f)) FILTER (speaker_label IS NOT NULL) AS speaker_label,
       sum(n) AS n FROM cnt GROUP BY ALL"""), bigint="n_words")
def top_sessions(spark, sf):
    w = b.words(spark, sf, timed=False)
    counts = w.groupBy("session_id", "seg_pos").agg(F.count(F.lit(1)).alias("n"))
    dom = speakers.dominant_speakers(w).join(counts, ["session_id", "seg_pos"])
    return (dom.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("n_words"),
                                          F.countDistinct("speaker_label").alias("n_speakers"))
            .orderBy(F.desc("n_segments"), F.desc("n_words"), "session_id"))


@query("dominant_speaker", b.with_ctes("words", """SELECT session_id, seg_pos,
    arg_max(speaker_label, (n, -f)) FILTER (speaker_label IS NOT NULL) AS speaker_label FROM cnt GROUP BY ALL""",
    cnt="SELECT session_id, seg_pos, speaker_label, count(*) AS n, min(word_index) AS f FROM words GROUP BY ALL"))
def dominant_speaker(spark, sf):
    return speakers.dominant_speakers(b.words(spark, sf, timed=False))


@query("word_speaker_overlap", b.with_ctes("turns", """SELECT w.session_id, w.event_id, p.speaker AS speaker_label,
    round(CASE WHEN p.speaker IS NULL THEN 0.0 ELSE least(p.ov / (w."end" - w."start"), 1.0) END, 6) AS coverage
    FROM timed_words w LEFT JOIN best p ON w.session_id = p.session_id AND w.event_id = p.event_id""", ovs=J1_SQL,
    best="""SELECT session_id, event_id, arg_max(speaker, (ov, -first_turn)) AS speaker, max(ov) AS ov FROM ovs GROUP BY ALL"""))
def word_speaker_overlap(spark, sf):
    w = b.timed_words(spark, sf)
    r = speakers.word_speakers(w, turn_table(spark, sf), S, ["event_id"], b.BUCKET)
    return r.withColumn("coverage", F.round("coverage", 6))


@query("coverage_fractions", b.with_ctes("turns", """SELECT o.session_id, o.event_id, o.speaker, round(o.ov / (w."end" - w."start"), 6) AS fraction,
    round(least(sum(o.ov) OVER (PARTITION BY o.session_id, o.event_id) / (w."end" - w."start"), 1.0), 6) AS total
    FROM ovs o JOIN timed_words w ON o.session_id = w.session_id AND o.event_id = w.event_id""", ovs=J1_SQL))
def coverage_fractions(spark, sf):
    r = speakers.coverage_fractions(b.timed_words(spark, sf), turn_table(spark, sf), S, ["event_id"], b.BUCKET)
    return r.withColumn("fraction", F.round("fraction", 6)).withColumn("total", F.round("total", 6))


COVER_SQL = """SELECT t.session_id, t."start", t."end", t.speaker,
    least(coalesce(sum(least(w."end", t."end") - greatest(w."start", t."start")) FILTER (w.event_id IS NOT NULL), 0) / any_value(t."end" - t."start"), 1.0) AS coverage
    FROM turns t LEFT JOIN short w ON w.session_id = t.session_id AND w."start" < t."end" AND t."start" < w."end" GROUP BY t.session_id, t."start", t."end", t.speaker"""
SHORT_SQL = """SELECT session_id, event_id, "start", "start" + ("end" - "start") // 20 AS "end" FROM timed_words"""


def short_words(spark, sf):
    return b.timed_words(spark, sf).withColumn("end", F.expr("start + (end - start) div 20"))


@query("turn_word_coverage", b.with_ctes("turns", """SELECT session_id, "start" AS start_us, "end" AS end_us, speaker, round(coverage, 6) AS coverage FROM cov""",
                                         short=SHORT_SQL, cov=COVER_SQL))
def turn_word_coverage(spark, sf):
    r = speakers.turn_word_coverage(turn_table(spark, sf), short_words(spark, sf), S, b.BUCKET)
    return r.select("session_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "speaker", F.round("coverage", 6).alias("coverage"))


@query("turn_neighbours", b.with_ctes("turns", """SELECT session_id, "start" AS start_us, speaker,
    (SELECT arg_max(event_id, (w."start", -event_id)) FROM timed_words w WHERE w.session_id = t.session_id AND w."start" < t."start") AS prev_event_id,
    (SELECT arg_min(event_id, (w."start", event_id)) FROM timed_words w WHERE w.session_id = t.session_id AND w."start" >= t."end") AS next_event_id
    FROM turns t"""))
def turn_neighbours(spark, sf):
    r = bracket(turn_table(spark, sf), b.timed_words(spark, sf), S, ["event_id"], "event_id", b.TIME_BLOCK)
    return r.select("session_id", F.col("start").alias("start_us"), "speaker", "prev_event_id", "next_event_id")


@query("unintelligible_gaps", b.with_ctes("turns", """SELECT session_id, printf('gap_%.3f', "start" / 1000000.0) AS seg_id, "start" AS start_us, "end" AS end_us,
    '[unintelligible]' AS text, speaker AS speaker_label FROM (SELECT *,
    (SELECT arg_max(coalesce(speaker_label, '-'), (w."start", -event_id)) FROM timed_words w WHERE w.session_id = c.session_id AND w."start" < c."start") AS p,
    (SELECT arg_min(coalesce(speaker_label, '-'), (w."start", event_id)) FROM timed_words w WHERE w.session_id = c.session_id AND w."start" >= c."end") AS n
    FROM cov c WHERE coverage < 0.3) WHERE p <> '-' AND n <> '-' AND speaker <> p AND speaker <> n""", short=SHORT_SQL, cov=COVER_SQL))
def unintelligible_gaps(spark, sf):
    g = speakers.unintelligible_gaps(turn_table(spark, sf), short_words(spark, sf), b.timed_words(spark, sf), S, "event_id",
                                     b.BUCKET, b.TIME_BLOCK, per_second=1e6)
    return g.select("session_id", "seg_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "text", "speaker_label")


MERGED = """SELECT session_id, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(isnew) OVER
    (PARTITION BY session_id ORDER BY "start", "end", event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN "start" <= max("end") OVER
    (PARTITION BY session_id ORDER BY "start", "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS isnew
    FROM {src} WHERE "end" > "start")) GROUP BY session_id, g"""


@query("merge_intervals", b.with_ctes("timed_words", 'SELECT session_id, "start" AS start_us, "end" AS end_us FROM m', m=MERGED.format(src="timed_words")))
def merge_intervals(spark, sf):
    m = iv.merge_intervals(b.timed_words(spark, sf), S, b.BUCKET)
    return m.select("session_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


GAPS_SQL = """SELECT * FROM (SELECT t.session_id, t.speaker, greatest(t."start", h.hs) AS "start", least(t."end", h.he) AS "end"
    FROM turns t JOIN holes h ON t.session_id = h.session_id AND h.hs < t."end" AND t."start" < h.he) WHERE "end" - "start" >= 3600000000"""
HOLES_SQL = """SELECT session_id, coalesce(lag("end") OVER w, -1000000000000000) AS hs, "start" AS he FROM m WINDOW w AS (PARTITION BY session_id ORDER BY "start")
    UNION ALL SELECT session_id, max("end"), 1000000000000000000 FROM m GROUP BY session_id"""
GAP_PARTS = {"short": SHORT_SQL, "m": MERGED.format(src="short"), "holes": HOLES_SQL, "gaps": GAPS_SQL}


def gap_table(spark, sf):
    return gp.find_gaps(staged(turn_table(spark, sf)), short_words(spark, sf), S, b.BUCKET, 3_600_000_000)


@query("missed_speech_gaps", b.with_ctes("turns", 'SELECT session_id, speaker, "start" AS start_us, "end" AS end_us, "end" - "start" AS duration FROM gaps', **GAP_PARTS))
def missed_speech_gaps(spark, sf):
    return gap_table(spark, sf).select("session_id", "speaker", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "duration")


@query("gap_context", b.with_ctes("turns", """SELECT session_id, "start" AS start_us, "end" AS end_us,
    (SELECT arg_max(word, (w."start", -event_id)) FROM timed_words w WHERE w.session_id = g.session_id AND w."start" < g."start") AS prev_word,
    (SELECT arg_min(word, (w."start", event_id)) FROM timed_words w WHERE w.session_id = g.session_id AND w."start" >= g."end") AS next_word
    FROM gaps g""", **GAP_PARTS))
def gap_context(spark, sf):
    g = gap_table(spark, sf).select("session_id", "start", "end")
    r = bracket(g, b.timed_words(spark, sf), S, ["word"], "event_id", b.TIME_BLOCK)
    return r.select("session_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "prev_word", "next_word")


@query("gap_tally", b.with_ctes("turns", """SELECT session_id,
    count(*) FILTER (d >= 3600000000) AS whole_n_1h, coalesce(sum(d) FILTER (d >= 3600000000), 0) AS whole_len_1h,
    count(*) FILTER (d >= 3600000000 AND s < 1296000000000) AS story_n_1h, coalesce(sum(d) FILTER (d >= 3600000000 AND s < 1296000000000), 0) AS story_len_1h,
    count(*) FILTER (d >= 14400000000) AS whole_n_4h, coalesce(sum(d) FILTER (d >= 14400000000), 0) AS whole_len_4h,
    count(*) FILTER (d >= 14400000000 AND s < 1296000000000) AS story_n_4h, coalesce(sum(d) FILTER (d >= 14400000000 AND s < 1296000000000), 0) AS story_len_4h
    FROM (SELECT session_id, "start" AS s, "end" - "start" AS d FROM gaps) GROUP BY session_id""", **GAP_PARTS), bigint="whole_len_1h story_len_1h whole_len_4h story_len_4h")
def gap_tally(spark, sf):
    g = gap_table(spark, sf).withColumn("story_end", F.lit(1296000000000))
    return gp.tally(g, S, {"1h": 3_600_000_000, "4h": 14_400_000_000}, "story_end")


@query("gap_recovered_words", b.with_ctes("turns", """SELECT g.session_id, g."start" AS gap_start, g."end" AS gap_end, string_agg(word, ' ' ORDER BY w."start" + w."end", event_id) AS words
    FROM gaps g JOIN timed_words w ON w.session_id = g.session_id AND w."start" + w."end" BETWEEN 2 * g."start" AND 2 * g."end" GROUP BY ALL""", **GAP_PARTS))
def gap_recovered_words(spark, sf):
    g = gap_table(spark, sf).select("session_id", "start", "end", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    heard = b.timed_words(spark, sf).withColumn("word_id", F.col("event_id"))
    r = gp.recovered_words(g, heard, S, ["gap_start", "gap_end"], b.BUCKET)
    from parley.operators.scans import ordered_text
    return ordered_text(r, ["session_id", "gap_start", "gap_end"], ["mid2", "word_id"], F.col("word"),
                        block_of("mid2", 64 * b.TIME_BLOCK), " ", "words")


@query("gap_recovery_yield", b.with_ctes("turns", """SELECT session_id, count(*) AS probed, count(*) FILTER (hit) AS with_words FROM (SELECT g.session_id,
    EXISTS (SELECT 1 FROM timed_words w WHERE w.session_id = g.session_id AND w."start" + w."end" BETWEEN 2 * g."start" AND 2 * g."end") AS hit FROM gaps g)
    GROUP BY session_id""", **GAP_PARTS))
def gap_recovery_yield(spark, sf):
    g = gap_table(spark, sf).select("session_id", "start", "end", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    heard = b.timed_words(spark, sf).withColumn("word_id", F.col("event_id"))
    r = gp.recovered_words(g, heard, S, ["gap_start", "gap_end"], b.BUCKET)
    return gp.recovery_yield(g, r, S, ["gap_start", "gap_end"])
