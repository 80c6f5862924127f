"""Queries over tokens, words and lines."""

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import filters as fl
from parley.operators import runs
from parley.operators.scans import block_of
from parley.plans import bindings as b
from parley.plans.catalog import query

SEG = ["session_id", "seg_pos"]


@query("clean_tokens", b.with_ctes("cwords", """SELECT c, cap AS capitalized, count(*) AS n, count(DISTINCT word) AS n_surfaces FROM cwords WHERE c <> '' GROUP BY c, cap"""))
def clean_tokens(spark, sf):
    w = b.words(spark, sf, timed=False).select("word", tx.clean("word").alias("c"), tx.is_capitalized("word").alias("capitalized"))
    return w.filter("c <> ''").groupBy("c", "capitalized").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("n_surfaces"))


@query("token_count", b.with_ctes("cwords", "SELECT session_id, count(*) FILTER (c <> '') AS n_tokens FROM cwords GROUP BY session_id"))
def token_count(spark, sf):
    return b.words(spark, sf, timed=False).groupBy("session_id").agg(F.count_if(tx.clean("word") != "").alias("n_tokens"))


@query("clean_transcript", b.with_ctes("words", """SELECT s.session_id, s.seg_pos, count(w.word_index) AS n_kept FROM segments s
    LEFT JOIN words w ON s.session_id = w.session_id AND s.seg_pos = w.seg_pos AND w."end" > w."start"
    WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND s."end" > s."start" GROUP BY ALL"""))
def clean_transcript(spark, sf):
    segs, words = fl.clean_transcript(b.segments(spark, sf), b.words(spark, sf))
    kept = words.groupBy(*SEG).agg(F.count(F.lit(1)).alias("n_kept"))
    return segs.select(*SEG).join(kept, SEG, "left").na.fill(0, ["n_kept"])


@query("suspicious_words", b.with_ctes("words", """SELECT session_id, seg_pos, word_index, speaker_label IS NULL AND coverage = 0 AS silent_word,
    coalesce(probability < 0.01, false) AS near_zero_word, count(*) OVER (PARTITION BY session_id, seg_pos) = 1 AS alone,
    CASE WHEN probability >= 0.7 THEN 'high' WHEN probability >= 0.3 THEN 'mid' ELSE 'low' END AS band FROM words"""))
def suspicious_words(spark, sf):
    from pyspark.sql import Window
    w = b.words(spark, sf, timed=False)
    alone = F.count(F.lit(1)).over(Window.partitionBy(*SEG)) == 1
    return w.select(*SEG, "word_index", fl.silence_gap().alias("silent_word"), fl.near_zero().alias("near_zero_word"),
                    alone.alias("alone"), fl.probability_band().alias("band"))


DUP = """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, {key} ORDER BY doc_id) AS rn
    FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '') WHERE rn > 1"""
STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def doc_lines(spark, sf):
    return b.table(spark, sf, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seg_pos"), "text")


@query("duplicate_segments", DUP.format(key=STRIPPED))
def duplicate_segments(spark, sf):
    d = fl.duplicate_segments(doc_lines(spark, sf), ["session_id"], "seg_pos", block_of("seg_pos", 65536))
    return d.select(F.col("seg_pos").alias("doc_id"), F.col("session_id").alias("source"))


@query("duplicate_segments_folded", DUP.format(key=f"lower({STRIPPED})"))
def duplicate_segments_folded(spark, sf):
    d = fl.duplicate_segments(doc_lines(spark, sf), ["session_id"], "seg_pos", block_of("seg_pos", 65536), fold_case=True)
    return d.select(F.col("seg_pos").alias("doc_id"), F.col("session_id").alias("source"))


REASONS = """SELECT session_id, seg_pos, array_to_string(list_filter([CASE WHEN seg_pos % 7 = 0 THEN 'duplicate' END, CASE WHEN n = 1 AND nz THEN 'near-zero' END, CASE WHEN n = 1 AND sil THEN 'silence-gap' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(epoch(date_trunc('hour', ts)) - 1704067200 AS BIGINT) // 3600 AS seg_pos, count(*) AS n, bool_or(event_type = 'error') AS sil, bool_or(value < 5) AS nz FROM events GROUP BY ALL)
    WHERE seg_pos % 7 = 0 OR n = 1 AND (sil OR nz)"""


@query("filter_reasons", REASONS)
def filter_reasons(spark, sf):
    e = b.timed_words(spark, sf)
    value = b.table(spark, sf, "events").select("event_id", "value")
    w = e.join(value, "event_id").select(
        "session_id", F.floor(F.col("start") / 3_600_000_000).alias("seg_pos"), "speaker_label",
        F.when(F.col("speaker_label").isNull(), 0.0).otherwise(1.0).alias("coverage"), (F.col("value") / 500).alias("probability"))
    r = fl.filter_reasons(w, w.filter("seg_pos % 7 = 0").select(*SEG).distinct())
    return r.select(*SEG, F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


@query("reason_counts", f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM ({REASONS})) GROUP BY reason")
def reason_counts(spark, sf):
    r = filter_reasons(spark, sf)
    return r.select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("low_confidence_words", b.with_ctes("words", """SELECT session_id, seg_pos, string_agg(word_index || ':' || word, ' ' ORDER BY word_index) AS words,
    count(*) AS n FROM words WHERE probability < 0.5 GROUP BY ALL"""))
def low_confidence_words(spark, sf):
    r = fl.low_confidence(b.words(spark, sf, timed=False))
    return r.select(*SEG, F.array_join(F.transform("words", lambda x: F.concat(x["word_index"].cast("string"), F.lit(":"), x["word"])), " ").alias("words"),
                    F.size("words").alias("n"))


@query("segment_classes", b.with_ctes("segments", """SELECT session_id, CASE WHEN NOT "end" > "start" THEN 'empty' WHEN is_gap THEN 'unintelligible' ELSE 'real' END AS cls,
    count(*) AS n, sum("end" - "start") AS total_ms FROM segments GROUP BY ALL"""), bigint="total_ms")
def segment_classes(spark, sf):
    s = b.segments(spark, sf)
    return s.groupBy("session_id", fl.segment_class().alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("total_ms"))


@query("segment_metadata", b.with_ctes("segments", """SELECT session_id, seg_pos, is_gap, "start" - lag("end") OVER (PARTITION BY session_id ORDER BY seg_pos) AS gap_before FROM segments"""))
def segment_metadata(spark, sf):
    from parley.operators.stories import line_facts
    return line_facts(b.segments(spark, sf), b.SEGMENT_BLOCK).select(*SEG, "is_gap", "gap_before")


@query("session_stats", b.with_ctes("words", """SELECT s.session_id, count(DISTINCT s.seg_pos) AS n_segments, count(w.word_index) AS n_words,
    count(DISTINCT w.speaker_label) AS n_speakers FROM segments s LEFT JOIN words w ON s.session_id = w.session_id AND s.seg_pos = w.seg_pos GROUP BY ALL"""))
def session_stats(spark, sf):
    segs = b.table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.count(F.lit(1)).alias("n_segments"))
    w = b.words(spark, sf, timed=False).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct("speaker_label").alias("n_speakers"))
    return segs.join(w, "session_id", "left").na.fill(0)


@query("token_classes", b.with_ctes("words", """SELECT session_id, count(*) FILTER (regexp_matches(word, '[^\\x00-\\x7f]') AND NOT regexp_matches(word, '[a-zA-Z]')) AS n_script,
    count(*) FILTER (lower(regexp_replace(word, '[^A-Za-z]', '', 'g')) IN (""" + b.FILLER_SQL + """)) AS n_filler FROM words GROUP BY session_id"""))
def token_classes(spark, sf):
    w = b.words(spark, sf, timed=False)
    return w.groupBy("session_id").agg(F.count_if(tx.token_class("word") == "script").alias("n_script"), F.count_if(tx.is_filler("word")).alias("n_filler"))


RUN_SQL = """SELECT *, sum(n) OVER (PARTITION BY session_id, seg_pos ORDER BY word_index ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *,
    CASE WHEN {v} IS NOT NULL AND lag({v}) OVER (PARTITION BY session_id, seg_pos ORDER BY word_index) = {v} THEN 0 ELSE 1 END AS n FROM lw)"""
LW = "SELECT *, nullif(regexp_replace(lower(word), '[^a-z]', '', 'g'), '') AS l, CASE WHEN coalesce(probability < 0.01, false) THEN 1 END AS z FROM words"


@query("repeat_runs", b.with_ctes("words", """SELECT session_id, seg_pos, min(word_index) AS word_index, count(*) AS length, any_value(l) AS token FROM rr
    WHERE l IS NOT NULL GROUP BY session_id, seg_pos, r HAVING count(*) >= 2""", lw=LW, rr=RUN_SQL.format(v="l")))
def repeat_runs(spark, sf):
    r = b.lines_of_words(spark, sf).select(*SEG, F.inline(runs.runs_in_segment(F.col("words"), fl.bare_word, 2)))
    return r.select(*SEG, "word_index", "length", tx.letters("first_word").alias("token"))


CENSUS = dict(lw=LW, rr=RUN_SQL.format(v="l"), zr=RUN_SQL.format(v="z"), found="""
    SELECT 'script' AS cls, session_id, seg_pos, word_index, "start", "end", word AS token FROM words WHERE regexp_matches(word, '[^\\x00-\\x7f]') AND NOT regexp_matches(word, '[a-zA-Z]')
    UNION ALL SELECT 'symbol', session_id, seg_pos, word_index, "start", "end", word FROM words WHERE regexp_full_match(word, '[^\\p{L}\\p{N}_]+')
      AND NOT (regexp_matches(word, '[^\\x00-\\x7f]') AND NOT regexp_matches(word, '[a-zA-Z]'))
    UNION ALL SELECT 'repeat', session_id, seg_pos, min(word_index), min("start"), max("end"), arg_min(word, word_index) || ' x' || count(*) FROM rr
      WHERE l IS NOT NULL AND (session_id, seg_pos) NOT IN (SELECT session_id, seg_pos FROM segments WHERE is_gap) GROUP BY session_id, seg_pos, r HAVING count(*) >= 3
    UNION ALL SELECT 'zeroprob', session_id, seg_pos, min(word_index), min("start"), max("end"), arg_min(word, word_index) FROM zr WHERE z IS NOT NULL GROUP BY session_id, seg_pos, r""",
              census="""SELECT f.*, s.speaker_label = 'user' AS coded FROM found f JOIN segments s ON f.session_id = s.session_id AND f.seg_pos = s.seg_pos""")


def census(spark, sf):
    s = b.lines(spark, sf)
    return fl.garbage_census(b.lines_of_words(spark, sf), s.filter("speaker_label = 'user'"), s.filter("is_gap"))


@query("garbage_census", b.with_ctes("words", 'SELECT cls, session_id, seg_pos, word_index, "start" AS start_ms, "end" AS end_ms, token, coded FROM census', **CENSUS))
def garbage_census(spark, sf):
    return census(spark, sf).withColumnRenamed("start", "start_ms").withColumnRenamed("end", "end_ms")


def _cells(where: str) -> str:
    return ", ".join(f"count(*) FILTER (cls = '{c}' AND NOT coded) AS {c}_uncoded, count(*) FILTER (cls = '{c}' AND coded) AS {c}_coded"
                     for c in ["script", "symbol", "repeat", "zeroprob"])


@query("census_table", b.with_ctes("words", f"SELECT coalesce(session_id, 'all') AS session_id, {_cells('')} FROM census GROUP BY ROLLUP (session_id)", **CENSUS))
def census_table(spark, sf):
    return fl.census_table(census(spark, sf))


@query("worst_picks", b.with_ctes("words", """SELECT cls, session_id, seg_pos, word_index, "end" - "start" AS span, token FROM census WHERE NOT coded
    ORDER BY CASE cls WHEN 'script' THEN 0 WHEN 'repeat' THEN 1 WHEN 'zeroprob' THEN 2 ELSE 3 END, "end" - "start" DESC, session_id, seg_pos, word_index, cls LIMIT 40""", **CENSUS))
def worst_picks(spark, sf):
    return fl.worst_picks(census(spark, sf), 40).select("cls", "session_id", "seg_pos", "word_index", "span", "token")


MISMATCH = dict(stream="""SELECT session_id, seg_pos, string_agg(' ' || word, '' ORDER BY word_index) AS rebuilt, count(*) AS nw FROM words WHERE probability IS NOT NULL GROUP BY ALL""",
                mm="""SELECT s.session_id, s.seg_pos, CASE WHEN len(toks) > nw THEN 'dropped' WHEN len(toks) = nw THEN 'name' ELSE 'added' END AS kind, nw AS n_words,
    ("end" - "start") / 1000.0 AS seconds, CASE WHEN "end" > "start" THEN nw / (("end" - "start") / 1000.0) ELSE 999.0 END AS wps
    FROM segments s JOIN stream m ON s.session_id = m.session_id AND s.seg_pos = m.seg_pos WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> trim(rebuilt)""")


def mismatch(spark, sf):
    w = b.words(spark, sf, timed=False).filter("probability is not null").withColumn("word", F.concat(F.lit(" "), "word"))
    return fl.text_word_mismatch(b.segments(spark, sf), w, 1000.0)


@query("text_word_mismatch", b.with_ctes("words", "SELECT session_id, seg_pos, kind, n_words, seconds, round(wps, 6) AS wps, seconds < 0.30 OR wps > 6.0 AS crammed FROM mm", **MISMATCH))
def text_word_mismatch(spark, sf):
    return mismatch(spark, sf).withColumn("wps", F.round("wps", 6))


@query("mismatch_totals", b.with_ctes("words", """SELECT coalesce(session_id, 'all') AS session_id, count(*) FILTER (kind = 'dropped' AND NOT coded) AS dropped_to_check,
    count(*) FILTER (kind = 'dropped' AND coded) AS dropped_coded, count(*) FILTER (kind = 'name') AS name, count(*) FILTER (kind = 'added') AS added FROM
    (SELECT m.*, s.speaker_label = 'user' AS coded FROM mm m JOIN segments s ON m.session_id = s.session_id AND m.seg_pos = s.seg_pos) GROUP BY ROLLUP (session_id)""", **MISMATCH))
def mismatch_totals(spark, sf):
    coded = b.segments(spark, sf).select(*SEG, (F.col("speaker_label") == "user").alias("coded"))
    m = mismatch(spark, sf).join(coded, SEG)
    kind, c = F.col("kind"), F.col("coded")
    t = m.rollup("session_id").agg(F.count_if((kind == "dropped") & ~c).alias("dropped_to_check"), F.count_if((kind == "dropped") & c).alias("dropped_coded"),
                                   F.count_if(kind == "name").alias("name"), F.count_if(kind == "added").alias("added"))
    return t.withColumn("session_id", F.coalesce("session_id", F.lit("all")))


@query("char_offsets", b.with_ctes("words", """SELECT session_id, seg_pos, word_index, coalesce(sum(length(word) + 1) OVER (PARTITION BY session_id, seg_pos ORDER BY word_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset", length(word) AS length FROM words"""), bigint="offset")
def char_offsets(spark, sf):
    w = b.words(spark, sf, timed=False).withColumn("word", F.concat(F.lit(" "), "word"))
    return fl.char_offsets(w).select(*SEG, "word_index", "offset", "length")


NAMES_SQL = r"""SELECT DISTINCT lower(unnest(list_concat(regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ [A-Za-z]+'), regexp_extract_all(text, '[A-Za-z]{9,}')))) AS name FROM benchmark"""


@query("name_mentions_in_documents", "WITH names AS (" + NAMES_SQL + r""") SELECT DISTINCT doc_id FROM documents JOIN names ON contains(lower(text), name)
    WHERE length(name) > 2 AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || regexp_escape(name) || '($|[^\p{L}\p{N}_])')""")
def name_mentions_in_documents(spark, sf):
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in ("[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ [A-Za-z]+", "[A-Za-z]{9,}")]
    names = b.table(spark, sf, "benchmark").select(F.explode(F.concat(*found)).alias("name"))
    return fl.mentions(b.table(spark, sf, "documents"), ["doc_id"], "text", names)


@query("slugs_and_worlds", """SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    regexp_replace(trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS world FROM pages""")
def slugs_and_worlds(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", tx.slug("url").alias("slug"), tx.normalize_world("url").alias("world"))


@query("text_shape", b.with_ctes("words", """SELECT session_id, seg_pos, string_agg(word, ' ' ORDER BY word_index) AS line, printf('%d:%02d', s // 60, s % 60) AS clock FROM
    (SELECT w.*, s."start" // 1000 AS s FROM words w JOIN segments s ON w.session_id = s.session_id AND w.seg_pos = s.seg_pos) GROUP BY session_id, seg_pos, s"""))
def text_shape(spark, sf):
    w = b.words(spark, sf, timed=False).withColumn("word", F.concat(F.lit(" "), "word"))
    t = fl.word_text(w).select(*SEG, F.btrim("rebuilt").alias("line"))
    s = b.segments(spark, sf).select(*SEG, tx.clock_grid(F.floor(F.col("start") / 1000)).alias("clock"))
    return t.join(s, SEG)


@query("sentence_starts", b.with_ctes("words", r"""SELECT session_id, count(*) FILTER (initial) AS n_initial, count(*) FILTER (NOT initial) AS n_inside FROM (SELECT session_id,
    coalesce(regexp_matches(lag(word) OVER (PARTITION BY session_id, seg_pos ORDER BY word_index), '[.!?…]$|[.!?]"$'), true) AS initial FROM words) GROUP BY session_id"""))
def sentence_starts(spark, sf):
    from parley.operators.names import sentence_initial
    w = sentence_initial(b.words(spark, sf, timed=False))
    return w.groupBy("session_id").agg(F.count_if("initial").alias("n_initial"), F.count_if(~F.col("initial")).alias("n_inside"))
