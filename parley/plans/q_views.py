"""Queries over texts for readers, speaker displays and review lists."""

import re

from pyspark.sql import functions as F

from parley.functions import phonetic as ph
from parley.functions import render
from parley.functions import text as tx
from parley.operators import catches as ct
from parley.operators import names as nm
from parley.operators import speakers
from parley.operators import stories as st
from parley.operators.scans import running_number
from parley.plans import bindings as b
from parley.plans import q_catches as qc
from parley.plans import q_names as qn
from parley.plans import q_speech as qp
from parley.plans import q_stories as qs
from parley.plans.catalog import query

S = ["session_id"]


@query("window_texts", b.with_ctes("segments", r"""SELECT session_id, zone, string_agg(line, chr(10) ORDER BY place) AS text FROM (
    SELECT w.session_id, zone, CAST(w.seg_pos AS DOUBLE) AS place, '[' || g.seg_id || '] "' || trim(text) || '"' || CASE WHEN len(signals) > 0 THEN '   (signals: ' || array_to_string(list_sort(signals), ', ') || ')' ELSE '' END AS line
    FROM wins w JOIN segments g ON g.session_id = w.session_id AND g.seg_pos = w.seg_pos JOIN cand c ON c.session_id = w.session_id AND c.pos = w.seg_pos
    UNION ALL SELECT session_id, zone, lo + 2.5, '   ... [' || (n_shown - 4) || ' lines omitted] ...' FROM wins WHERE after_elision) GROUP BY ALL""", **qs.PARTS, wins=qs.WINDOWS), bigint="zone")
def window_texts(spark, sf):
    from parley.session import materialize
    c = materialize(qs.candidates(spark, sf))
    w = st.zone_windows(st.boundary_zones(c, b.SEGMENT_BLOCK, 1), qs.lengths(spark, sf), **qs.SHORT)
    return render.window_texts(w, b.lines(spark, sf), c)


@query("cast_sentences", f"""WITH casts AS ({qc.CASTS}), cst AS ({qc.CAST}), r AS (SELECT *, row_number() OVER (PARTITION BY world ORDER BY cast_rank) AS i FROM cst) SELECT world, 'This is a bedtime story about the ' || world || '. Its characters include ' ||
    string_agg(name, ', ' ORDER BY i) FILTER (i <= 6) || coalesce(', and ' || string_agg(name, ', ' ORDER BY i) FILTER (i BETWEEN 7 AND 20), '') || '.' AS sentence FROM r GROUP BY world""")
def cast_sentences(spark, sf):
    return render.cast_sentences(ct.correction_cast(qc.casts(spark, sf)))


@query("card_lists", b.with_ctes("cwords", r"""SELECT c.session_id, c.card_key, '[' || card_id || '] spellings: ' || (SELECT string_agg(DISTINCT '"' || word || '"', ', ' ORDER BY '"' || word || '"') FROM us u WHERE u.session_id = c.session_id AND u.card_key = c.card_key) || '  (' || n || ' uses)' ||
    CASE WHEN is_phrase THEN ' [multi-word]' ELSE '' END || coalesce(chr(10) || (SELECT string_agg('    - "' || left(line, 130) || '"', chr(10) ORDER BY p) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, card_key ORDER BY p) AS rk FROM
    (SELECT u.session_id, u.card_key, trim(g.text) AS line, min(u.seg_pos) AS p FROM us u JOIN segments g ON g.session_id = u.session_id AND g.seg_pos = u.seg_pos GROUP BY ALL)) x WHERE rk <= 3 AND x.session_id = c.session_id AND x.card_key = c.card_key), '') AS text FROM cards c""",
    **qn.CARDS, us="""SELECT w.session_id, w.seg_pos, m.card_key, w.word FROM iw w JOIN mem m ON w.session_id = m.session_id AND w.c = m.c
      UNION ALL SELECT w.session_id, w.seg_pos, w.c || ' ' || w.c2, w.word || ' ' || w.word2 FROM iw w JOIN phr p ON w.session_id = p.session_id AND w.c = p.c AND w.c2 = p.c2"""))
def card_lists(spark, sf):
    w, cards, members = qn.cards_of(spark, sf)
    occ = nm.card_occurrences(w, members, S)
    return render.card_lists(cards, occ.select("session_id", "card_key", F.col("token").alias("surface")),
                             nm.card_examples(occ, b.lines(spark, sf), S), S)


# the two cluster walks need names of their own in one statement
_TWO = {"edge": "edge2", "walk": "walk2", "clu": "clu2", "common": "common2"}


def _renamed(text: str) -> str:
    return re.sub(r"\b(edge|walk|clu)\b", lambda m: _TWO[m.group(1)], text)


REVIEW = qn.M9B | {_TWO.get(k, k): (v if k == "common" else _renamed(v)) for k, v in qn.CARDS.items()} | {
    "vv": "SELECT DISTINCT c FROM cwords WHERE c <> '' AND c NOT IN (SELECT form FROM pform)", "vc": f"SELECT c, unnest({b.skeleton_sql('c')}) AS code FROM vv",
    "hit": "SELECT c FROM vc JOIN pcode USING (code) UNION SELECT c FROM vv WHERE c IN (SELECT form FROM aform)",
    "ph": "SELECT w.session_id, w.seg_pos, w.word_index, w.c || ' ' || w.c2 AS c FROM iw w JOIN phr p ON w.session_id = p.session_id AND w.c = p.c AND w.c2 = p.c2"}


@query("review_list", b.with_ctes("cwords", """SELECT session_id, seg_pos, word_index, c, detectors, cap, watch, is_phrase, line FROM (
      SELECT o.session_id, o.seg_pos, o.word_index, o.c, coalesce(dets, '') AS detectors, cap, dets IS NULL AS watch, false AS is_phrase FROM occ2 o
      LEFT JOIN named n ON o.session_id = n.session_id AND o.c = n.c LEFT JOIN cov v ON o.session_id = v.session_id AND o.seg_pos = v.seg_pos AND o.word_index = v.wi WHERE v.p IS NULL
      UNION ALL SELECT h.session_id, h.seg_pos, h.word_index, h.c, coalesce(dets, ''), cap, false, true FROM phx h LEFT JOIN carried k ON h.session_id = k.session_id AND h.c = k.p)
    JOIN (SELECT session_id, seg_pos, string_agg(word, ' ' ORDER BY word_index) AS line FROM cwords GROUP BY ALL) USING (session_id, seg_pos)""", **REVIEW,
    found="SELECT DISTINCT session_id, cwords.c, 'm9a' AS det FROM cwords JOIN hit ON cwords.c = hit.c WHERE cap UNION SELECT DISTINCT session_id, c, 'm9b' FROM flags",
    named="SELECT session_id, c, string_agg(det, ',' ORDER BY det) AS dets FROM found GROUP BY ALL",
    interest="SELECT session_id, c FROM found UNION SELECT session_id, c FROM sing",
    occ2="SELECT w.session_id, w.seg_pos, w.word_index, w.c, w.cap FROM cwords w JOIN interest i ON w.session_id = i.session_id AND w.c = i.c",
    phx=f"""SELECT w.session_id, w.seg_pos, w.word_index, w.c || ' ' || w.c2 AS c, cap OR regexp_matches(word2, {b.CAP}) AS cap, min((w.seg_pos, w.word_index)) OVER (PARTITION BY w.session_id, w.c, w.c2) AS first
      FROM iw w JOIN phr p ON w.session_id = p.session_id AND w.c = p.c AND w.c2 = p.c2""",
    cov="SELECT session_id, seg_pos, wi, arg_max(c, first) AS p FROM (SELECT *, word_index AS wi FROM phx UNION ALL SELECT *, word_index + 1 FROM phx) GROUP BY ALL",
    carried="""SELECT o.session_id, p, string_agg(DISTINCT det, ',' ORDER BY det) AS dets FROM occ2 o JOIN cov v ON o.session_id = v.session_id AND o.seg_pos = v.seg_pos AND o.word_index = v.wi
      JOIN found f ON o.session_id = f.session_id AND o.c = f.c GROUP BY o.session_id, p"""))
def review_list(spark, sf):
    w = qn.cleaned_words(spark, sf)
    people, aliases = qn.roster(spark, sf)
    flags, _ = qn.m9b(spark, sf, w)
    r = nm.review_list(w, nm.family_names(w, people, aliases, ph.skeleton_codes), flags, S)
    return r.drop("coded").withColumn("detectors", F.array_join("detectors", ","))


@query("retagged_stories", b.with_ctes("segments", """SELECT g.session_id, g.seg_pos, max(story_idx) AS story_idx FROM segments g LEFT JOIN sto s ON g.session_id = s.session_id AND g.seg_pos BETWEEN s.start_pos AND s.end_pos GROUP BY ALL""", **qs.U, sto=qs.STORIES))
def retagged_stories(spark, sf):
    tagged = b.lines(spark, sf).withColumn("story_idx", F.lit(99)).withColumn("title", F.lit("old"))
    return st.retag_stories(tagged, qs.stories(spark, sf), 64).select("session_id", "seg_pos", "story_idx")


@query("injected_segments", b.with_ctes("timed_words", """SELECT session_id, start_us, event_id, source, row_number() OVER (PARTITION BY session_id ORDER BY start_us, r, event_id) AS place FROM (
    SELECT session_id, "start" AS start_us, event_id, NULL AS source, 0 AS r FROM timed_words UNION ALL SELECT session_id, "start", NULL, 'diarization_gap', 1 FROM timed_words WHERE speaker_label IS NULL)"""))
def injected_segments(spark, sf):
    w = b.timed_words(spark, sf)
    gaps = w.filter("speaker_label is null").select("session_id", "start", "end", F.lit("diarization_gap").alias("source"))
    both = speakers.inject_gaps(w, gaps)
    placed = running_number(both.withColumn("_e", F.coalesce("event_id", F.lit(2**62))), ["session_id"], ["start", "sort_rank", "_e"], b.time_block(), "place")
    return placed.select("session_id", F.col("start").alias("start_us"), "event_id", "source", "place")


@query("speaker_displays", b.with_ctes("vectors", """SELECT speaker_key, profile_id, CAST(min(vec_id % 100) OVER (PARTITION BY grp) AS INTEGER) AS number, CAST(min(vec_id % 100) OVER (PARTITION BY grp) % 5 AS INTEGER) AS color, 'Speaker ' || vec_id % 100 AS display, session_id FROM
    (SELECT vec_id // 100 AS session_id, vec_id, printf('SPEAKER_%02d', vec_id % 100) AS speaker_key, CASE WHEN profile_id < '5' THEN profile_id END AS profile_id, vec_id // 100 || '/' || CASE WHEN profile_id < '5' THEN profile_id ELSE printf('SPEAKER_%02d', vec_id % 100) END AS grp FROM vectors)"""))
def speaker_displays(spark, sf):
    v = b.vectors(spark, sf).select(F.floor(F.col("vec_id") / 100).alias("session_id"), F.format_string("SPEAKER_%02d", F.col("vec_id") % 100).alias("speaker_key"),
                                    F.when(F.col("profile_id") < "5", F.col("profile_id")).alias("profile_id"))
    g = speakers.speaker_group_numbers(v, S, "speaker_key", "profile_id")
    return g.withColumn("display", tx.speaker_display("speaker_key"))


@query("transcript_lines", b.with_ctes("timed_words", """SELECT session_id, min("start") AS start_us, coalesce(max(speaker_label), 'UNKNOWN') || ': ' || string_agg(word, ' ' ORDER BY "start", event_id) AS line FROM runs GROUP BY session_id, run""",
    marked="""SELECT *, CASE WHEN speaker_label IS NOT NULL AND lag(speaker_label) OVER (PARTITION BY session_id ORDER BY "start", event_id) = speaker_label THEN 0 ELSE 1 END AS isnew FROM timed_words""",
    runs="""SELECT *, sum(isnew) OVER (PARTITION BY session_id ORDER BY "start", event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked"""))
def transcript_lines(spark, sf):
    return qp.utterances(spark, sf).select("session_id", "start_us", speakers.transcript_line().alias("line"))


@query("session_rows", b.with_ctes("segments", "SELECT seg_pos, speaker_label, n_words FROM segments WHERE session_id = '7'"))
def session_rows(spark, sf):
    return b.lines(spark, sf, session=7).select("seg_pos", "speaker_label", "n_words")


@query("world_answers", r"""SELECT page_id, CASE WHEN lower(trim(w)) IN ('', 'original', 'made up', 'made-up', 'none', 'unknown', 'n/a') THEN '' ELSE w END AS world FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' Original' WHEN 1 THEN 'n/a' ELSE url END AS w FROM pages)""")
def world_answers(spark, sf):
    m = F.col("page_id") % 4
    p = b.table(spark, sf, "pages").select("page_id", F.when(m == 0, " Original").when(m == 1, "n/a").otherwise(F.col("url")).alias("w"))
    return p.select("page_id", tx.world_or_none("w").alias("world"))
