"""Queries over dictionaries, corrections and alignment."""

from uuid import uuid4

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import corrections as co
from parley.operators import decisions as dc
from parley.operators import names as nm
from parley.plans import bindings as b
from parley.plans.catalog import query
from parley.session import ensure_checkpoint_dir, staged

AT = nm.AT
LIB = r"""SELECT item_id AS entry_pos, i, lower(t) AS v, 'N' || item_id || substr(t, 1, 3) AS canonical FROM (SELECT item_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM
    (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS p FROM benchmark))
    UNION ALL SELECT item_id, 99999, lower(array_to_string(regexp_extract_all(text, '[^\s]*[A-Za-z]')[1:2 + item_id % 5], ' ')), 'P' || item_id FROM benchmark"""
VMAP = "SELECT v AS transcribed, arg_max(canonical, (entry_pos, i)) AS correct FROM lib WHERE v <> lower(canonical) GROUP BY v"
PUNCT = r"""'^(.*?)([.,;:!?"\)\]}'']+\.{0,3})$'"""
SPLIT = rf"""SELECT *, CASE WHEN regexp_matches(bare0, '^(.+)([''’]s)$') THEN regexp_extract(bare0, '^(.+)([''’]s)$', 1) ELSE bare0 END AS bare,
    CASE WHEN regexp_matches(bare0, '^(.+)([''’]s)$') THEN regexp_extract(bare0, '^(.+)([''’]s)$', 2) ELSE '' END AS suf FROM (SELECT *,
    CASE WHEN regexp_matches(word, {PUNCT}) THEN regexp_extract(word, {PUNCT}, 1) ELSE word END AS bare0, CASE WHEN regexp_matches(word, {PUNCT}) THEN regexp_extract(word, {PUNCT}, 2) ELSE '' END AS punct FROM words)"""
APPLIED = """SELECT session_id, seg_pos, word_index, CASE WHEN correct IS NOT NULL THEN correct || suf || punct ELSE word END AS word, CASE WHEN correct IS NOT NULL THEN word END AS original,
    CASE WHEN correct IS NOT NULL THEN 'dictionary:' || bare || '>' || correct ELSE '' END AS history FROM sp LEFT JOIN vmap ON lower(bare) = transcribed"""
PARTS = dict(lib=LIB, vmap=VMAP, sp=SPLIT, app=APPLIED)


def library(spark, sf):
    toks = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    e = b.table(spark, sf, "benchmark").select("item_id", F.posexplode(toks).alias("i", "t"))
    words = e.select((F.col("item_id") * 100000 + F.col("i")).alias("entry_pos"), F.concat(F.lit("N"), F.col("item_id").cast("string"), F.substring("t", 1, 3)).alias("canonical"),
                     F.array("t").alias("variants"))
    first = F.slice(F.regexp_extract_all("text", F.lit(r"[^\s]*[A-Za-z]"), F.lit(0)), F.lit(1), (2 + F.col("item_id") % 5).cast("int"))
    phrases = b.table(spark, sf, "benchmark").select((F.col("item_id") * 100000 + 99999).alias("entry_pos"), F.concat(F.lit("P"), F.col("item_id").cast("string")).alias("canonical"),
                                                     F.array(F.array_join(first, " ")).alias("variants"))
    return words.unionByName(phrases)


def vmap(spark, sf):
    return co.variant_map(library(spark, sf))


def applied(spark, sf):
    return co.apply_corrections(b.words(spark, sf, timed=False), vmap(spark, sf).withColumn("ordinal", F.lit(0)), "dictionary")


def history(col="corrections"):
    return F.array_join(F.transform(col, lambda c: F.concat(c["stage"], F.lit(":"), c["from"], F.lit(">"), c["to"])), ";")


@query("variant_map", f"WITH lib AS ({LIB}) {VMAP}")
def variant_map(spark, sf):
    return vmap(spark, sf)


BEFORE = r"CASE WHEN p[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(p[i], 1), '[\p{L}\p{N}_]') END"
AFTER = r"CASE WHEN p[i + 1] = '' THEN i + 1 = len(p) ELSE NOT regexp_matches(left(p[i + 1], 1), '[\p{L}\p{N}_]') END"


@query("variant_scan", f"""WITH lib AS ({LIB}), vmap AS ({VMAP}) SELECT doc_id, substr(text, (1 + list_sum(list_transform(p[1:spot], lambda x: length(x))) + (spot - 1) * length(v))::BIGINT, length(v)) AS transcribed, correct
    FROM (SELECT *, list_filter(range(1, len(p)), lambda i: {BEFORE} AND {AFTER})[1] AS spot FROM (SELECT doc_id, text, transcribed AS v, correct, string_split(lower(text), transcribed) AS p FROM documents JOIN vmap ON contains(lower(text), transcribed))) WHERE spot IS NOT NULL""")
def variant_scan(spark, sf):
    return co.variant_scan(b.table(spark, sf, "documents"), ["doc_id"], vmap(spark, sf))


COUNTED = f"""SELECT canonical, v, doc_id, len(list_filter(range(1, len(p)), lambda i: {BEFORE} AND (prefix OR {AFTER}))) AS n
    FROM (SELECT canonical, v, prefix, doc_id, string_split(lower(text), v) AS p FROM documents JOIN names ON contains(lower(text), v))"""


@query("name_counts", f"""WITH lib AS ({LIB}), names AS (SELECT DISTINCT canonical, v, entry_pos % 3 = 0 AS prefix FROM lib), found AS ({COUNTED})
    SELECT canonical, sum(n) AS n, count(DISTINCT v) AS n_variants, count(DISTINCT doc_id) AS n_texts FROM found WHERE n > 0 GROUP BY canonical""", bigint="n")
def name_counts(spark, sf):
    names = library(spark, sf).select("canonical", F.explode("variants").alias("variant"), (F.floor(F.col("entry_pos") / 100000) % 3 == 0).alias("prefix"))
    return co.occurrences_by_pattern(b.table(spark, sf, "documents"), ["doc_id"], names.withColumn("variant", F.lower("variant")))


@query("split_punctuation", b.with_ctes("words", "SELECT session_id, seg_pos, word_index, bare, suf AS suffix, punct FROM sp", sp=SPLIT))
def split_punctuation(spark, sf):
    stem, suffix, punct = tx.split_punct("word")
    return b.words(spark, sf, timed=False).select(*AT, stem.alias("bare"), suffix.alias("suffix"), punct.alias("punct"))


@query("apply_corrections", b.with_ctes("words", "SELECT * FROM app", **PARTS))
def apply_corrections(spark, sf):
    return applied(spark, sf).select(*AT, "word", "original", history().alias("history"))


@query("healed_text", b.with_ctes("words", "SELECT session_id, seg_pos, string_agg(word, '' ORDER BY word_index) AS text FROM app GROUP BY ALL", **PARTS))
def healed_text(spark, sf):
    return co.heal_text(b.lines(spark, sf), applied(spark, sf)).select("session_id", "seg_pos", "text")


POS = "SELECT session_id, seg_pos, word_index, 'Z' || length(word) AS canonical FROM words WHERE probability < 0.1"


@query("apply_at_positions", b.with_ctes("words", f"""SELECT w.session_id, w.seg_pos, w.word_index, CASE WHEN p.canonical IS NOT NULL THEN p.canonical || CASE WHEN regexp_matches(word, {PUNCT}) THEN regexp_extract(word, {PUNCT}, 2) ELSE '' END ELSE word END AS word,
    CASE WHEN p.canonical IS NOT NULL THEN word END AS original FROM words w LEFT JOIN pos p USING (session_id, seg_pos, word_index)""", pos=POS))
def apply_at_positions(spark, sf):
    w = b.words(spark, sf, timed=False)
    pos = w.filter("probability < 0.1").select(*AT, F.concat(F.lit("Z"), F.length("word").cast("string")).alias("canonical"))
    return co.apply_at(w, pos, "namefix_bless").select(*AT, "word", "original")


@query("revert_stage", b.with_ctes("words", "SELECT session_id, seg_pos, word_index, word, 0 AS n_history FROM words"))
def revert_stage(spark, sf):
    once = co.apply_corrections(b.words(spark, sf, timed=False), vmap(spark, sf).withColumn("ordinal", F.lit(0)), "llm_pass")
    return co.revert_stage(once).select(*AT, "word", F.size("corrections").alias("n_history"))


@query("shape_changes", b.with_ctes("words", """SELECT a.session_id, a.seg_pos, n_before, n_after FROM (SELECT session_id, seg_pos, count(*) AS n_before FROM words GROUP BY ALL) a
    LEFT JOIN (SELECT session_id, seg_pos, count(*) AS n_after FROM words WHERE probability IS NOT NULL GROUP BY ALL) c USING (session_id, seg_pos) WHERE n_before IS DISTINCT FROM n_after"""))
def shape_changes(spark, sf):
    w = b.words(spark, sf, timed=False)
    return co.shape_changes(w, w.filter("probability is not null"))


@query("correction_audit", b.with_ctes("words", """SELECT session_id, seg_pos, word_index, bare AS before, correct || suf || punct AS after, 'namefix' AS stage, line FROM sp JOIN vmap ON lower(bare) = transcribed
    JOIN (SELECT session_id, seg_pos, trim(string_agg(word, '' ORDER BY word_index)) AS line FROM app GROUP BY ALL) USING (session_id, seg_pos)""", **PARTS))
def correction_audit(spark, sf):
    w = co.apply_corrections(b.words(spark, sf, timed=False), vmap(spark, sf).withColumn("ordinal", F.lit(0)), "namefix")
    return co.correction_audit(w)


PEND = "SELECT 'w' || CAST(session_id AS INTEGER) % 4 AS world, c AS key, 'P' || substr(c, 1, 2) AS canonical, session_id, seg_pos, word_index FROM cwords WHERE cap AND length(c) >= 7"


def pending(spark, sf):
    w = nm.cleaned(b.words(spark, sf, timed=False)).filter("cap").filter(F.length("c") >= 7)
    return w.select(F.concat(F.lit("w"), (F.col("session_id").cast("int") % 4).cast("string")).alias("world"), F.col("c").alias("key"),
                    F.concat(F.lit("P"), F.substring("c", 1, 2)).alias("canonical"), *AT)


@query("bless_split", b.with_ctes("cwords", """SELECT world, key, canonical, count(*) FILTER (seg_pos < 3) AS applied, count(*) FILTER (seg_pos >= 3) AS waiting FROM pend GROUP BY ALL""", pend=PEND))
def bless_split(spark, sf):
    p = pending(spark, sf)
    chosen, rest = co.split_pending(p, p.filter("seg_pos < 3"))
    both = chosen.withColumn("_c", F.lit(1)).unionByName(rest.withColumn("_c", F.lit(0)))
    return both.groupBy("world", "key", "canonical").agg(F.sum("_c").alias("applied"), F.sum(1 - F.col("_c")).alias("waiting"))


@query("bless_dictionary", b.with_ctes("cwords", """SELECT world, canonical, key AS variant FROM (SELECT DISTINCT world, key, canonical FROM pend WHERE lower(key) <> lower(canonical))
    UNION ALL SELECT 'w9', 'Old', 'olde'""", pend=PEND))
def bless_dictionary(spark, sf):
    p = staged(pending(spark, sf).select("world", "canonical", F.col("key").alias("heard")).distinct())
    # one world known before, and half of the pairs twice in another case
    old = p.limit(0).select("world", "canonical", F.col("heard").alias("variant")).unionByName(
        p.sparkSession.range(1).select(F.lit("w9").alias("world"), F.lit("Old").alias("canonical"), F.lit("olde").alias("variant")))
    once = co.bless(old, p)
    return co.bless(once, p.withColumn("heard", F.upper("heard")))


@query("moved_groups", b.with_ctes("cwords", """SELECT session_id, key, CASE WHEN length(key) % 3 = 0 THEN 'rejected' WHEN length(key) % 3 = 1 THEN 'auto' ELSE 'pending' END AS state FROM (SELECT DISTINCT session_id, key FROM pend)""", pend=PEND))
def moved_groups(spark, sf):
    g = pending(spark, sf).select("session_id", "key").distinct().withColumn("state", F.lit("pending"))
    n = F.length("key") % 3
    moves = g.filter(n < 2).select("session_id", "key", F.when(n == 0, "rejected").otherwise("auto").alias("state"))
    return co.move_groups(g, moves)


KEEP = "SELECT w.*, s.text, s.is_gap FROM words w JOIN segments s USING (session_id, seg_pos) WHERE (w.seg_pos % 2 = 0 OR probability IS NOT NULL)"
ALIGN_PARTS = dict(
    kw="""SELECT w.* FROM words w WHERE (w.seg_pos % 2 = 0 OR probability IS NOT NULL)""",
    al="""SELECT session_id, seg_pos, i AS token_no, s + 310 * i AS s, s + 310 * i + 290 AS e, (length(t) % 10) / 10.0 AS conf FROM (SELECT session_id, seg_pos, "start" + 10 AS s, unnest(toks) AS t, unnest(range(len(toks))) AS i FROM segments)""",
    fx="""SELECT s.session_id, s.seg_pos, s."start", s."end", len(toks) AS nt, nw, cf, CASE WHEN len(toks) = nw THEN 'realigned' WHEN len(toks) > nw AND len(toks) <= greatest(2 * nw, nw + 4) AND cf >= 0.30 THEN 'rescued' ELSE 'guarded' END AS status
        FROM segments s JOIN (SELECT session_id, seg_pos, count(*) AS nw FROM kw GROUP BY ALL) k USING (session_id, seg_pos) JOIN (SELECT session_id, seg_pos, avg(conf) AS cf, max(e) AS me, min(s) AS ms FROM al GROUP BY ALL) a USING (session_id, seg_pos) WHERE NOT is_gap""")


@query("alignment_merge", b.with_ctes("words", """SELECT s.session_id, s.seg_pos, coalesce(status, 'untouched') AS status, CASE WHEN status IN ('realigned', 'rescued') THEN least(s."start", ms) ELSE s."start" END AS start_ms,
    CASE WHEN status IN ('realigned', 'rescued') THEN greatest(s."end", me) ELSE s."end" END AS end_ms, CASE WHEN status = 'rescued' THEN nt ELSE coalesce(k2.n, 0) END AS n_words FROM segments s LEFT JOIN fx USING (session_id, seg_pos)
    LEFT JOIN (SELECT session_id, seg_pos, min(s) AS ms, max(e) AS me FROM al GROUP BY ALL) a USING (session_id, seg_pos) LEFT JOIN (SELECT session_id, seg_pos, count(*) AS n FROM kw GROUP BY ALL) k2 USING (session_id, seg_pos)""", **ALIGN_PARTS))
def alignment_merge(spark, sf):
    w = b.words(spark, sf).filter("seg_pos % 2 = 0 or probability is not null")
    s = b.segments(spark, sf)
    al = s.select("session_id", "seg_pos", F.col("start").alias("_s"), F.posexplode(tx.tokens("text")).alias("token_no", "t")).select(
        "session_id", "seg_pos", "token_no", (F.col("_s") + 10 + 310 * F.col("token_no")).alias("s"), (F.col("_s") + 300 + 310 * F.col("token_no")).alias("e"),
        ((F.length("t") % 10) / 10.0).alias("conf"))
    words, segs = co.alignment_merge(w, s, al)
    n = words.groupBy("session_id", "seg_pos").agg(F.count(F.lit(1)).alias("n_words"))
    return segs.drop("n_words").join(n, ["session_id", "seg_pos"], "left").na.fill(0, ["n_words"]).select(
        "session_id", "seg_pos", "status", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n_words")


QUEUE = """SELECT *, CASE WHEN length(key) % 4 = 3 THEN 'auto' ELSE 'pending' END AS state, length(key) % 4 = 0 OR (length(key) % 4 = 1 AND seg_pos % 2 = 0) AS picked
    FROM (SELECT DISTINCT 'w' || CAST(session_id AS INTEGER) % 4 AS world, c AS key, 'P' || substr(c, 1, 2) AS canonical, session_id, seg_pos, word_index FROM cwords WHERE cap AND length(c) >= 4)"""
FATE = """SELECT session_id, key, world, canonical, state, count(*) AS n, count(*) FILTER (picked) AS n_picked, length(key) % 4 AS m, CAST(session_id AS INTEGER) % 2 = 0 AS even FROM queue GROUP BY ALL"""
DECIDED = dict(queue=QUEUE, fate=FATE)


def decision_store(spark, sf):
    """A store after one batch: groups blessed whole or in even segments, rejected, and (in every other recording) demoted."""
    w = nm.cleaned(b.words(spark, sf, timed=False))
    n = F.length("key") % 4
    queue = w.filter("cap").filter(F.length("c") >= nm.MIN_NAME).select(
        F.concat(F.lit("w"), (F.col("session_id").cast("int") % 4).cast("string")).alias("world"), F.col("c").alias("key"), F.col("c").alias("heard"),
        F.concat(F.lit("P"), F.substring("c", 1, 2)).alias("canonical"), *AT)
    queue = staged(queue.withColumn("state", F.when(n == 3, "auto").otherwise("pending")))
    path = f"{ensure_checkpoint_dir(spark)}/decisions-{uuid4().hex}"
    dc.create(w.drop("c", "cap"), queue, queue.limit(0).select("world", "canonical", F.col("key").alias("variant")), path, parts=8)
    asked = queue.select("session_id", "key").distinct().filter((n != 3) | (F.col("session_id").cast("int") % 2 == 0)).select(
        F.xxhash64("session_id", "key").alias("ordinal"), "session_id", "key",
        F.when(n < 2, "bless").when(n == 2, "reject").otherwise("demote").alias("action"), F.lit(None).cast("string").alias("canonical"))
    # a group meant in even segments only has such places named, one that has none a place that is not there
    some = queue.filter(n == 1)
    named = some.filter("seg_pos % 2 = 0").select("session_id", "key", "seg_pos", "word_index").unionByName(
        some.select("session_id", "key").distinct().select("*", F.lit(-1).alias("seg_pos"), F.lit(-1).alias("word_index")))
    return path, dc.decide(spark, path, asked, named)


@query("decided_words", b.with_ctes("cwords", f"""SELECT w.session_id, w.seg_pos, w.word_index, CASE WHEN p.canonical IS NOT NULL THEN p.canonical || CASE WHEN regexp_matches(word, {PUNCT}) THEN regexp_extract(word, {PUNCT}, 2) ELSE '' END ELSE word END AS word,
    CASE WHEN p.canonical IS NOT NULL THEN word END AS original FROM cwords w LEFT JOIN (SELECT * FROM queue WHERE picked) p USING (session_id, seg_pos, word_index)""", **DECIDED))
def decided_words(spark, sf):
    path, _ = decision_store(spark, sf)
    return dc.state(spark, path, "words").select(*AT, "word", "original")


@query("decided_state", b.with_ctes("cwords", """SELECT 'waiting' AS part, session_id AS scope, key, canonical, CASE WHEN m = 2 THEN 'rejected' WHEN m = 3 AND even THEN 'pending' ELSE state END AS state, n - n_picked AS n FROM fate WHERE n > n_picked
    UNION ALL SELECT DISTINCT 'dictionary', world, key, arg_canon, NULL, 1 FROM (SELECT *, min(canonical) OVER (PARTITION BY world, lower(canonical)) AS arg_canon FROM fate WHERE n_picked = n) WHERE lower(key) <> lower(canonical)
    UNION ALL SELECT 'audit', session_id, key, canonical, CASE WHEN m < 2 THEN 'blessed' WHEN m = 2 THEN 'rejected' ELSE 'demoted' END, CASE WHEN m < 2 THEN n_picked ELSE n END FROM fate WHERE n_picked > 0 OR m = 2 OR (m = 3 AND even)
    UNION ALL SELECT 'audit', session_id, key, canonical, 'variant', 0 FROM fate WHERE n_picked = n
    UNION ALL SELECT 'outcome', session_id, key, NULL, CASE WHEN m = 2 THEN 'rejected' WHEN m = 3 THEN 'demoted' WHEN n_picked = 0 THEN 'no matching place' WHEN n_picked < n THEN 'partly blessed' ELSE 'blessed' END, CASE WHEN m < 2 THEN n_picked ELSE n END FROM fate WHERE m < 3 OR even""", **DECIDED), bigint="n")
def decided_state(spark, sf):
    """Queue, dictionary and audit after the batch, and what became of each decision."""
    path, outcome = decision_store(spark, sf)
    waiting = dc.state(spark, path, "waiting").groupBy(F.lit("waiting").alias("part"), F.col("session_id").alias("scope"), "key", "canonical", "state").agg(F.count(F.lit(1)).alias("n"))
    learnt = dc.state(spark, path, "dictionary").select(F.lit("dictionary").alias("part"), F.col("world").alias("scope"), F.col("variant").alias("key"), "canonical",
                                                       F.lit(None).cast("string").alias("state"), F.lit(1).cast("long").alias("n"))
    audit = dc.state(spark, path, "audit").select(F.lit("audit").alias("part"), F.col("session_id").alias("scope"), "key", "canonical", F.col("kind").alias("state"),
                                                  F.coalesce("n_places", F.lit(0).cast("long")).alias("n"))
    told = outcome.select(F.lit("outcome").alias("part"), F.col("session_id").alias("scope"), "key", F.lit(None).cast("string").alias("canonical"), F.col("status").alias("state"), F.col("n_places").alias("n"))
    return waiting.unionByName(learnt).unionByName(audit).unionByName(told)
