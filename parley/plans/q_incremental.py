"""Queries over intake, fingerprints and bookkeeping tables."""

from uuid import uuid4

from pyspark.sql import functions as F

from parley.operators import incremental as inc
from parley.operators.filters import near_zero
from parley.operators.registry import Detector, ledger, scan
from parley.plans import bindings as b
from parley.plans.catalog import query
from parley.session import ensure_checkpoint_dir
from parley.sources import layout, tables

SEGFP = "SELECT session_id, seg_pos, sha256(string_agg(word, chr(10) ORDER BY word_index)) AS fp FROM words GROUP BY ALL"


@query("segment_fingerprints", b.with_ctes("words", "SELECT session_id, seg_pos, fp FROM segfp", segfp=SEGFP))
def segment_fingerprints(spark, sf):
    return inc.segment_fingerprints(b.words(spark, sf, timed=False))


SESFP = "SELECT session_id, sha256(string_agg(fp, chr(10) ORDER BY blk)) AS fp FROM (SELECT session_id, seg_pos // 4 AS blk, sha256(string_agg(fp, chr(10) ORDER BY seg_pos)) AS fp FROM segfp GROUP BY ALL) GROUP BY session_id"


@query("session_fingerprints", b.with_ctes("words", SESFP, segfp=SEGFP))
def session_fingerprints(spark, sf):
    return inc.session_fingerprints(b.words(spark, sf, timed=False), 4)


@query("stale_sessions", b.with_ctes("words", """SELECT session_id, stage FROM (SELECT session_id, 'm9b' AS stage, fp FROM sesfp) WHERE CAST(session_id AS INTEGER) % 3 <> 0""", segfp=SEGFP, sesfp=SESFP))
def stale_sessions(spark, sf):
    # sessions of every third id were finished with this input, of the next third with an older one
    now = inc.session_fingerprints(b.words(spark, sf, timed=False), 4).withColumn("stage", F.lit("m9b")).withColumn("config", inc.config_stamp("m9b", "1.0"))
    third = F.col("session_id").cast("int") % 3
    done = now.filter(third < 2).withColumn("fp", F.when(third == 0, F.col("fp")).otherwise("old"))
    return inc.stale(now, done).select("session_id", "stage")


ARR = """SELECT doc_id AS ordinal, CASE WHEN doc_id % 4 > 0 THEN md5(left(lower(text), 12)) END AS uuid, source || '-' || n_chars % 50 AS session_id, md5(text) AS md5 FROM documents WHERE lang <> 'de'"""
KNOWN = """SELECT CASE WHEN doc_id % 4 > 0 THEN md5(left(lower(text), 12)) END AS uuid, source || '-' || n_chars % 50 AS session_id, md5(text) AS md5 FROM documents WHERE lang = 'de'"""


def arrivals(spark, sf, cond):
    d = b.table(spark, sf, "documents").filter(cond)
    return d.select(F.col("doc_id").alias("ordinal"), F.when(F.col("doc_id") % 4 > 0, F.md5(F.left(F.lower("text"), F.lit(12)))).alias("uuid"),
                    F.concat("source", F.lit("-"), F.col("n_chars") % 50).alias("session_id"), F.md5("text").alias("md5"))


@query("intake", f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS n FROM ({ARR})), k AS ({KNOWN}), walk AS (
    SELECT CAST(0 AS BIGINT) AS n, (SELECT coalesce(list(uuid), []) FROM k WHERE uuid IS NOT NULL) AS us, (SELECT coalesce(list(DISTINCT session_id), []) FROM k) AS ss,
        (SELECT coalesce(list(session_id || '|' || md5), []) FROM k) AS ps, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS VARCHAR) AS verdict
    UNION ALL SELECT n, CASE WHEN v = 'new' AND uuid IS NOT NULL THEN list_append(us, uuid) ELSE us END, CASE WHEN v = 'new' THEN list_append(ss, session_id) ELSE ss END,
        CASE WHEN v = 'new' THEN list_append(ps, session_id || '|' || md5) ELSE ps END, ordinal, session_id, v
    FROM (SELECT a.*, us, ss, ps, CASE WHEN list_contains(us, a.uuid) OR list_contains(ps, a.session_id || '|' || a.md5) THEN 'duplicate' WHEN list_contains(ss, a.session_id) THEN 'collision' ELSE 'new' END AS v
          FROM walk w JOIN a ON a.n = w.n + 1))
    SELECT ordinal, session_id, verdict FROM walk WHERE n > 0""")
def intake(spark, sf):
    v = inc.classify_intake(arrivals(spark, sf, "lang <> 'de'"), arrivals(spark, sf, "lang = 'de'").drop("ordinal"))
    return v.select("ordinal", "session_id", "verdict")


@query("key_staleness", b.with_ctes("words", """SELECT session_id, CASE CAST(session_id AS INTEGER) % 3 WHEN 0 THEN 'unstamped' WHEN 1 THEN 'current' ELSE 'stale' END AS state FROM words GROUP BY session_id"""))
def key_staleness(spark, sf):
    now = inc.session_fingerprints(b.words(spark, sf, timed=False), 4)
    third = F.col("session_id").cast("int") % 3
    return inc.key_staleness(now.select("session_id", F.when(third == 1, F.col("fp")).when(third == 2, "before").alias("stamp")), now)


@query("section_replace", """SELECT detector_id, session_id, flag_id FROM (SELECT event_type AS detector_id, CAST(user_id AS VARCHAR) AS session_id, event_id AS flag_id FROM events WHERE value <= 100) o
    WHERE NOT (CAST(session_id AS INTEGER) % 3 = 0 AND detector_id IN ('view', 'click')) UNION ALL
    SELECT event_type, CAST(user_id AS VARCHAR), event_id FROM events WHERE value > 100 AND user_id % 3 = 0 AND event_type IN ('view', 'click')""")
def section_replace(spark, sf):
    e = b.table(spark, sf, "events").select(F.col("event_type").alias("detector_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("flag_id"), "value")
    done = e.filter("cast(session_id as int) % 3 = 0 and detector_id in ('view', 'click')")
    keys = ["detector_id", "session_id"]
    return tables.replace_sections(e.filter("value <= 100").drop("value"), done.filter("value > 100").drop("value"), done, keys)


@query("stage_health", "SELECT event_type AS stage, count(*) AS n_runs, count(*) FILTER (value > 100) AS n_failed, round(sum(value), 2) AS seconds FROM events GROUP BY event_type")
def stage_health(spark, sf):
    p = b.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") > 100, "error").otherwise("success").alias("status"), F.col("value").alias("duration_seconds"))
    return inc.stage_health(p)


@query("note_upsert", """SELECT event_id AS note_id, CASE WHEN event_type = 'view' THEN 'changed' ELSE event_type END AS text FROM events WHERE event_type <> 'error'""")
def note_upsert(spark, sf):
    e = b.table(spark, sf, "events").select(F.col("event_id").alias("note_id"), F.col("event_type").alias("text"))
    changed = e.filter("text = 'view'").withColumn("text", F.lit("changed"))
    return inc.remove(inc.upsert(e, changed, ["note_id"]), e.filter("text = 'error'"), ["note_id"])


@query("session_status", """SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN max(value) > 200 THEN 'done' WHEN max(value) > 100 THEN 'in_progress' ELSE 'not_started' END AS validation_status, 'n' || count(*) AS note FROM events GROUP BY user_id""")
def session_status(spark, sf):
    u = b.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.max("value").alias("m"), F.count(F.lit(1)).alias("n"))
    meta = u.select("session_id", F.concat(F.lit("n"), "n").alias("note"), F.lit(None).cast("string").alias("validation_status"))
    ch = u.filter("m > 100").select("session_id", F.when(F.col("m") > 200, "done").otherwise("in_progress").alias("validation_status"), F.lit(None).cast("string").alias("note"))
    return inc.set_status(meta, ch)


SID = "'202401' || lpad(CAST(1 + user_id % 28 AS VARCHAR), 2, '0') || '-' || lpad(CAST(user_id AS VARCHAR), 6, '0')"


@query("session_inventory", f"""SELECT {SID} AS session_id, bool_or(event_type = 'view') AS has_transcript, bool_or(event_type = 'click') AS has_diarization, count(*) FILTER (event_type = 'signup') AS note_count,
    coalesce(array_to_string(list_sort(list_distinct(list('s' || CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 4) FILTER (event_type = 'error' AND value > 50))), ','), '') AS failed_stages FROM events GROUP BY user_id""")
def session_inventory(spark, sf):
    u = F.col("user_id")
    e = b.table(spark, sf, "events").withColumn("session_id", F.concat(F.lit("202401"), F.lpad((1 + u % 28).cast("string"), 2, "0"), F.lit("-"), F.lpad(u.cast("string"), 6, "0")))
    failed = e.filter("event_type = 'error'").select("session_id", F.concat(F.lit("s"), F.regexp_extract("props", r"(\d+)", 1).cast("int") % 4).alias("stage"), F.when(F.col("value") > 50, "error").otherwise("success").alias("status"))
    inv = inc.session_inventory(e.select("session_id").distinct(), {"transcript": e.filter("event_type = 'view'"), "diarization": e.filter("event_type = 'click'")},
                                e.filter("event_type = 'signup'"), failed, e.select("session_id").distinct().withColumn("label", F.lit("-")))
    return inv.select("session_id", "has_transcript", "has_diarization", "note_count", F.array_join("failed_stages", ",").alias("failed_stages"))


@query("sorted_sessions", f"""SELECT {SID} AS session_id, count(*) AS note_count FROM events GROUP BY user_id """)
def sorted_sessions(spark, sf):
    u = F.col("user_id")
    e = b.table(spark, sf, "events").groupBy(F.concat(F.lit("202401"), F.lpad((1 + u % 28).cast("string"), 2, "0"), F.lit("-"), F.lpad(u.cast("string"), 6, "0")).alias("session_id"))
    return inc.sort_sessions(e.agg(F.count(F.lit(1)).alias("note_count")), "notes")


@query("benchmark_assembly", """SELECT printf('s%03d', CAST(row_number() OVER (ORDER BY list_position(['fr', 'en', 'es', 'de'], lang), doc_id) AS INTEGER)) AS id, lang AS cell, CASE WHEN doc_id % 11 = 0 THEN 'missing keys' ELSE array_to_string(list_filter([
      CASE WHEN n < 6 THEN 'too few lines' END, CASE WHEN made AND src <> '' THEN 'made_up names a world' END, CASE WHEN NOT made AND src = '' THEN 'no world' END], lambda x: x IS NOT NULL), ',') END AS errors,
    CASE WHEN made AND contains(lower(text), 'tion the') THEN 'franchise named' ELSE '' END AS warnings FROM (SELECT *, len(string_split(text, chr(10))) AS n, doc_id % 3 = 0 AS made, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS src FROM documents)""")
def benchmark_assembly(spark, sf):
    return assembled(spark, sf).select("id", "cell", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("benchmark_counts", """SELECT lang AS cell, count(*) AS n, CASE WHEN lang = 'en' THEN 620 ELSE 0 END AS expected, count(*) = CASE WHEN lang = 'en' THEN 620 ELSE 0 END AS ok FROM documents GROUP BY lang
    UNION ALL SELECT 'it', 0, 5, false""")
def benchmark_counts(spark, sf):
    return inc.benchmark_counts(assembled(spark, sf), spark.createDataFrame([("en", 620), ("it", 5)], "cell string, expected long"))


def assembled(spark, sf):
    d = b.table(spark, sf, "documents")
    parts = d.select(F.col("lang").alias("cell"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 0, "made_up").otherwise("canon").alias("bucket"), F.when(F.col("doc_id") % 11 > 0, "obvious").alias("difficulty"),
                     F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("world_gold"), F.array().cast("array<string>").alias("world_aliases"), F.split("text", "\n").alias("lines"), F.lit("").alias("tell_note"))
    return inc.assemble_benchmark(parts, ["fr", "en", "es", "de"], ["tion the"])


def long_words(words, _judge):
    return words.filter(F.length("word") >= 12).select("session_id", "seg_pos", "word_index", F.lit("long").alias("kind"), F.col("word").alias("detail"))


def doubtful(threshold):
    """A detector of words under a probability, with the threshold as its settings."""
    def run(words, _judge):
        return words.filter(near_zero(threshold)).select("session_id", "seg_pos", "word_index", F.lit("low").alias("kind"), F.col("word").alias("detail"))
    return Detector("doubtful", "Doubtful words", "M1", "1", run, config=f"threshold={threshold}")


@query("detector_rescan", b.with_ctes("words", """SELECT session_id, detector_id, CASE WHEN detector_id = 'doubtful' OR CAST(session_id AS BIGINT) % 5 = 0 THEN 2 ELSE 1 END AS run_no,
    count(*) AS n_word_tokens, count(*) FILTER (CASE detector_id WHEN 'doubtful' THEN coalesce(probability < 0.5, false) ELSE length(w) >= 12 END) AS n_flags,
    CASE detector_id WHEN 'doubtful' THEN 'threshold=0.5' END AS config
    FROM (SELECT *, CASE WHEN CAST(session_id AS BIGINT) % 5 = 0 AND word_index = 0 THEN word || '-edited' ELSE word END AS w FROM words), (SELECT unnest(['doubtful', 'long_words']) AS detector_id) GROUP BY ALL"""))
def detector_rescan(spark, sf):
    """The ledger after a second scan: every fifth recording was edited, and one detector has other settings."""
    path = f"{ensure_checkpoint_dir(spark)}/sections-{uuid4().hex}"
    words = b.words(spark, sf, timed=False)
    plain = Detector("long_words", "Long words", "M2", "1", long_words)
    scan(words, path, [doubtful(0.3), plain])
    edited = F.when((F.col("session_id").cast("long") % 5 == 0) & (F.col("word_index") == 0), F.concat("word", F.lit("-edited"))).otherwise(F.col("word"))
    scan(words.withColumn("word", edited), path, [doubtful(0.5), plain])
    return ledger(spark, path).select("session_id", "detector_id", F.col("run_no").cast("int").alias("run_no"), "n_word_tokens", "n_flags", "config")


@query("clustered_segments", b.with_ctes("words", """SELECT session_id, seg_pos, s.is_gap, s.text, count(*) AS n_words, sum(length(word)) AS n_letters
    FROM words w JOIN segments s USING (session_id, seg_pos) GROUP BY ALL"""), bigint="n_letters")
def clustered_segments(spark, sf):
    """Words and segments written as bucketed tables, joined and counted by segment where they lie."""
    name = f"clustered_{uuid4().hex}"
    made = layout.Layout(name, f"{ensure_checkpoint_dir(spark)}/{name}", buckets=8, by_day=False)
    layout.save(b.words(spark, sf, timed=False).select("session_id", "seg_pos", "word_index", "word"), made, "words")
    layout.save(b.lines(spark, sf).select("session_id", "seg_pos", "is_gap", "text"), made, "segments")
    return layout.segment_words(spark, made).groupBy("session_id", "seg_pos", "is_gap", "text").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum(F.length("word")).cast("long").alias("n_letters"))
