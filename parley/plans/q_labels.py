"""Queries over human failure codes."""

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import labels as lb
from parley.operators import names as nm
from parley.plans import bindings as b
from parley.plans.catalog import query

K = ["session_id", "seg_id"]


def codes(spark, sf):
    return b.codes_of_documents(spark, sf)


@query("failure_pivot", b.with_ctes("doc_codes", """SELECT mode, session_id, count(*) AS n FROM (SELECT session_id, unnest(list_distinct(codes)) AS mode FROM doc_codes)
    GROUP BY GROUPING SETS ((mode, session_id), (mode))"""))
def failure_pivot(spark, sf):
    return lb.failure_pivot(codes(spark, sf))


@query("multi_coded", b.with_ctes("doc_codes", "SELECT session_id, count(*) AS n_labels, count(*) FILTER (len(codes) > 1) AS n_multi FROM doc_codes GROUP BY session_id"))
def multi_coded(spark, sf):
    return lb.multi_coded(codes(spark, sf))


@query("other_failures", b.with_ctes("doc_codes", "SELECT session_id, seg_id, array_to_string(list_filter(codes, lambda c: c NOT IN ('NotA', 'M7')), ',') AS others FROM doc_codes"))
def other_failures(spark, sf):
    return codes(spark, sf).select(*K, F.array_join(lb.other_failures(), ",").alias("others"))


LONG = "SELECT source AS session_id, doc_id AS seg_id FROM documents WHERE n_chars > 500"


@query("merge_code", b.with_ctes("doc_codes", """SELECT coalesce(l.session_id, s.session_id) AS session_id, coalesce(l.seg_id, s.seg_id) AS seg_id,
    CASE WHEN s.seg_id IS NULL THEN NULL WHEN codes IS NULL THEN 'new' WHEN list_contains(codes, 'M2') THEN 'already' WHEN codes = ['NotA'] THEN 'replaced' ELSE 'added' END AS change,
    array_to_string(CASE WHEN s.seg_id IS NULL OR list_contains(codes, 'M2') THEN codes ELSE list_concat(list_filter(coalesce(codes, CAST([] AS VARCHAR[])), lambda c: c <> 'NotA'), ['M2']) END, ',') AS codes
    FROM doc_codes l FULL JOIN long s ON l.session_id = s.session_id AND l.seg_id = s.seg_id""", long=LONG))
def merge_code(spark, sf):
    seg = b.table(spark, sf, "documents").filter("n_chars > 500").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seg_id"))
    m = lb.merge_code(codes(spark, sf).select(*K, "codes"), seg, "M2")
    return m.withColumn("codes", F.array_join("codes", ","))


@query("toggle_code", b.with_ctes("doc_codes", """SELECT session_id, seg_id, array_to_string(n, ',') AS codes FROM (SELECT l.session_id, l.seg_id, CASE WHEN p.code IS NULL THEN codes
    WHEN p.code = 'NotA' THEN CASE WHEN list_contains(codes, 'NotA') THEN [] ELSE ['NotA'] END WHEN list_contains(codes, p.code) THEN list_filter(codes, lambda c: c NOT IN ('NotA', p.code))
    ELSE list_concat(list_filter(codes, lambda c: c <> 'NotA'), [p.code]) END AS n FROM doc_codes l LEFT JOIN press p ON l.seg_id = p.seg_id) WHERE len(n) > 0""",
    press="SELECT doc_id AS seg_id, CASE WHEN n_chars % 2 = 0 THEN 'NotA' ELSE 'M1' END AS code FROM documents WHERE n_chars > 300 AND doc_id IN (SELECT doc_id FROM labels)"))
def toggle_code(spark, sf):
    l = codes(spark, sf)
    press = l.filter("n_chars > 300").select(*K, F.when(F.col("n_chars") % 2 == 0, "NotA").otherwise("M1").alias("code"))
    return lb.toggle(l.select(*K, "codes"), press).withColumn("codes", F.array_join("codes", ","))


FOLD = """SELECT session_id, seg_pos, 'M1' AS codes FROM lab WHERE (session_id, seg_pos) NOT IN (SELECT session_id, seg_pos FROM fold)
    UNION ALL SELECT DISTINCT session_id, seg_pos, 'M10' FROM (SELECT session_id, lo, min(seg_pos) AS seg_pos FROM fold GROUP BY ALL)"""


@query("fold_loops", f"""WITH seg AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_pos, event_type AS text FROM events),
    lab AS (SELECT session_id, seg_pos FROM seg WHERE text <> 'view'), str AS (SELECT session_id, seg_pos AS lo, seg_pos + 9 AS hi, 'click' AS filler FROM seg WHERE seg_pos % 10 = 0),
    fold AS (SELECT g.session_id, lo, g.seg_pos FROM seg g JOIN str s ON g.session_id = s.session_id AND g.seg_pos BETWEEN lo AND hi AND g.text = s.filler) {FOLD}""")
def fold_loops(spark, sf):
    from parley.operators.scans import running_number
    e = b.timed_words(spark, sf).join(b.table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    seg = running_number(e, ["session_id"], ["start", "event_id"], b.time_block(), "n").select("session_id", (F.col("n") - 1).alias("seg_pos"), F.col("event_type").alias("text"))
    lab = seg.filter("text <> 'view'").select("session_id", "seg_pos", F.array(F.lit("M1")).alias("codes"))
    stretches = seg.filter("seg_pos % 10 = 0").select("session_id", F.col("seg_pos").alias("lo"), (F.col("seg_pos") + 9).alias("hi"), F.lit("click").alias("filler"))
    return lb.fold_loops(seg, lab, stretches, 16).withColumn("codes", F.array_join("codes", ","))


@query("case_breakout", b.with_ctes("cwords", """SELECT w.session_id, v.case_ AS "case", count(*) AS n FROM cwords w JOIN segments s ON w.session_id = s.session_id AND w.seg_pos = s.seg_pos JOIN v ON w.c = v.form WHERE s.speaker_label = 'user' GROUP BY ALL""",
    v="""SELECT DISTINCT CASE item_id % 3 WHEN 0 THEN 'M9a' WHEN 1 THEN 'M9b' ELSE 'M9c' END AS case_, form FROM (SELECT item_id, """ + b.clean_sql("t") + """ AS form FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\\s+')) AS t FROM benchmark)) WHERE form <> ''"""))
def case_breakout(spark, sf):
    t = b.table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", r"\s+")).alias("t"))
    i = F.col("item_id") % 3
    v = t.select(F.when(i == 0, "M9a").when(i == 1, "M9b").otherwise("M9c").alias("case"), tx.clean("t").alias("form")).filter("form <> ''").distinct()
    lab = b.lines(spark, sf).filter("speaker_label = 'user'").select("session_id", "seg_pos", F.array(F.lit("M9")).alias("codes"))
    return lb.case_breakout(nm.cleaned(b.words(spark, sf, timed=False)), lab, v)


@query("coded_membership", b.with_ctes("doc_codes", "SELECT d.source AS session_id, count(*) FILTER (l.seg_id IS NOT NULL) AS n_coded, count(*) AS n FROM documents d LEFT JOIN doc_codes l ON d.doc_id = l.seg_id GROUP BY ALL"))
def coded_membership(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seg_id"))
    c = codes(spark, sf).select("seg_id").withColumn("coded", F.lit(1))
    return d.join(c, "seg_id", "left").groupBy("session_id").agg(F.count("coded").alias("n_coded"), F.count(F.lit(1)).alias("n"))
