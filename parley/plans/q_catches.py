"""Queries over catches: casts, votes, matches, gates, decisions and their groups."""

from pyspark.sql import functions as F

from parley.functions import phonetic as ph
from parley.functions import text as tx
from parley.operators import catches as ct
from parley.operators import names as nm
from parley.plans import bindings as b
from parley.plans import q_names as qn
from parley.plans.catalog import query

S = ["session_id"]
CASTS = """SELECT 'w' || item_id % 4 AS world, CASE WHEN item_id % 3 = 0 THEN 'groups' ELSE 'characters' END AS kind, item_id AS rank,
    regexp_extract(text, '([A-Za-z]{5,})', 1) AS name FROM benchmark"""
CAST = f"""SELECT world, form, name, rn AS cast_rank FROM (SELECT *, row_number() OVER (PARTITION BY world, form ORDER BY k, rank) AS one, row_number() OVER (PARTITION BY world ORDER BY k, rank) AS rn
    FROM (SELECT *, {b.clean_sql('name')} AS form, CASE WHEN kind = 'groups' THEN 0 ELSE 1 END AS k FROM casts)) WHERE one = 1 AND form <> ''"""
MADE = """SELECT DISTINCT session_id, c, r AS round FROM cwords, (SELECT unnest(range(7)) AS r) WHERE cap AND length(c) >= 6 AND (length(c) * 5 + r * r) % 7 < 3"""
CATCH = """SELECT session_id, round, c AS wrong, upper(substr(c, 1, 1)) || substr(c, 2, 2 + (round * length(c)) % 3) AS canonical FROM made"""
VOTE = """SELECT session_id, wrong AS key, sum(n) AS vote_count, arg_min(canonical, (-n, canonical)) AS canonical FROM
    (SELECT session_id, wrong, canonical, count(*) AS n FROM catch GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= 3"""
OWNER = f"""SELECT world, code, arg_min(name, (cast_rank, r)) AS canonical FROM (SELECT world, name, cast_rank, unnest({b.skeleton_sql('form')}) AS code, unnest(range(len({b.skeleton_sql('form')}))) AS r FROM cst) GROUP BY ALL"""
FORM = "SELECT session_id, c, 'w' || CAST(session_id AS INTEGER) % 4 AS world FROM mem WHERE length(c) >= 4"
SOUND = f"""SELECT session_id, c AS key, arg_min(canonical, r) AS canonical FROM (SELECT f.*, unnest({b.skeleton_sql('c')}) AS code, unnest(range(len({b.skeleton_sql('c')}))) AS r FROM frm f
    WHERE (world, c) NOT IN (SELECT world, form FROM cst)) f JOIN owner o ON f.world = o.world AND f.code = o.code GROUP BY ALL"""
COMB = """SELECT session_id, key, arg_min(canonical, m) AS canonical, array_to_string(list_sort(list_distinct(list(CASE m WHEN 0 THEN 'phonetic' ELSE 'judge' END)), 'DESC'), ',') AS methods,
    CASE WHEN min(m) = 1 THEN max(vote_count) END AS vote_count FROM (SELECT session_id, key, 0 AS m, canonical, NULL AS vote_count FROM sound UNION ALL SELECT session_id, key, 1, canonical, vote_count FROM vot) GROUP BY ALL"""
COMMON_TEST = "({0} IN (SELECT word FROM common) OR ({0} LIKE '%s' AND substr({0}, 1, length({0}) - 1) IN (SELECT word FROM common)))"
ORD = "({t} AND (session_id, {0}) NOT IN (SELECT session_id, c FROM sing) AND {0} <> '')"


def _ordinary(x):
    return ORD.format(x, t=COMMON_TEST.format(x))


GATED = f"""SELECT session_id, key, canonical, methods, vote_count FROM (SELECT *, {b.clean_sql('canonical')} AS cc FROM comb) g WHERE NOT {_ordinary('key')}"""
USES = """SELECT w.session_id, w.seg_pos, w.word_index, w.word AS token, g.key, g.canonical, g.methods, g.vote_count FROM iw w JOIN gated g ON w.session_id = g.session_id AND w.c = g.key
    UNION ALL SELECT w.session_id, w.seg_pos, w.word_index, w.word || ' ' || w.word2, g.key, g.canonical, g.methods, g.vote_count FROM iw w JOIN gated g ON w.session_id = g.session_id AND w.c || w.c2 = g.key
      WHERE NOT EXISTS (SELECT 1 FROM gated h WHERE h.session_id = w.session_id AND h.key = w.c)"""
SURE = f"""SELECT *, len(list_intersect({b.skeleton_sql('key')}, {b.skeleton_sql(b.clean_sql('canonical'))})) > 0 AS confident FROM uses"""
PARTS = dict(qn.CARDS, casts=CASTS, cst=CAST, made=MADE, catch=CATCH, vot=VOTE, owner=OWNER, frm=FORM, sound=SOUND, comb=COMB, gated=GATED, uses=USES, sure=SURE)
FORM0 = f"SELECT DISTINCT session_id, c, 'w' || CAST(session_id AS INTEGER) % 4 AS world FROM cwords WHERE cap AND length(c) >= 4"
SND = dict(casts=CASTS, cst=CAST, owner=OWNER, frm=FORM0, sound=SOUND)


def casts(spark, sf):
    i = F.col("item_id")
    return b.table(spark, sf, "benchmark").select(
        F.concat(F.lit("w"), (i % 4).cast("string")).alias("world"), F.when(i % 3 == 0, "groups").otherwise("characters").alias("kind"),
        i.alias("rank"), F.regexp_extract("text", "([A-Za-z]{5,})", 1).alias("name"))


def judged(words):
    """Made-up model answers: longer capitalised forms, caught in some of seven rounds."""
    w = nm.cleaned(words).filter("cap").filter(F.length("c") >= 6).select("session_id", "c").distinct()
    r = w.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(6)))).filter((F.length("c") * 5 + F.col("round") * F.col("round")) % 7 < 3)
    canonical = F.concat(F.upper(F.substring("c", 1, 1)), F.col("c").substr(F.lit(2), 2 + (F.col("round") * F.length("c")) % 3))
    return r.select("session_id", "round", F.lit(0).alias("line_no"), F.col("c").alias("wrong"), canonical.alias("canonical"))


def world_of(df):
    return df.withColumn("world", F.concat(F.lit("w"), (F.col("session_id").cast("int") % 4).cast("string")))


@query("correction_cast", f"WITH casts AS ({CASTS}), cst AS ({CAST}) SELECT world, form, name FROM cst")
def correction_cast(spark, sf):
    return ct.correction_cast(casts(spark, sf)).select("world", "form", "name")


@query("cast_lines", r"""SELECT item_id, arg_min(name, i) AS name FROM (SELECT item_id, i, regexp_replace(regexp_replace(trim(regexp_replace(l, '^[\s\-*.\d)]+', '')), '^[",]+|[",]+$', '', 'g'), '^[Tt]he\s+', '') AS name
    FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM (SELECT item_id, replace(text, '. ', chr(10)) AS text FROM benchmark)))
    WHERE name <> '' AND length(name) <= 40 AND NOT regexp_matches(name, '[^\x00-\x7f]') AND NOT regexp_matches(name, '[:{}\[\]]') GROUP BY item_id, lower(name)""")
def cast_lines(spark, sf):
    raw = b.table(spark, sf, "benchmark").select("item_id", F.replace("text", F.lit(". "), F.lit("\n")).alias("raw"))
    return ct.cast_lines(raw, ["item_id"]).select("item_id", "name")


@query("judge_lines", r"""SELECT item_id, arg_min(w, i) AS wrong, arg_min(r, i) AS canonical, key FROM (SELECT item_id, i, w, r, lower(w) AS key FROM (SELECT item_id, i, regexp_extract(l, '^([A-Za-z]+)', 1) AS w, regexp_extract(l, '([A-Za-z]+)$', 1) AS r
    FROM (SELECT item_id, unnest(p) AS l, unnest(range(len(p))) AS i FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{2,} [A-Za-z]{2,}') AS p FROM benchmark)))) WHERE lower(w) <> lower(r) GROUP BY item_id, key""")
def judge_lines(spark, sf):
    pairs = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,} [A-Za-z]{2,}"), F.lit(0))
    raw = b.table(spark, sf, "benchmark").select("item_id", F.array_join(F.transform(pairs, lambda p: F.regexp_replace(p, " ", " --> ")), "\n").alias("raw"))
    return ct.judge_lines(raw, ["item_id"]).select("item_id", "wrong", "canonical", "key")


@query("judge_vote", b.with_ctes("cwords", "SELECT * FROM vot", made=MADE, catch=CATCH, vot=VOTE), bigint="vote_count")
def judge_vote(spark, sf):
    return ct.vote(judged(b.words(spark, sf, timed=False)), S, 7).select("session_id", "key", "vote_count", "canonical")


@query("sound_match", b.with_ctes("cwords", "SELECT * FROM sound", **SND))
def sound_match(spark, sf):
    forms = world_of(nm.cleaned(b.words(spark, sf, timed=False)).filter("cap").select("session_id", "c"))
    return ct.sound_match(forms, ct.correction_cast(casts(spark, sf)), S, ph.skeleton_codes)


@query("near_codes", b.with_ctes("cwords", f"""SELECT DISTINCT f.world, c, form FROM (SELECT world, c, unnest({b.skeleton_sql('c')}) AS code FROM (SELECT DISTINCT world, c FROM frm)) f
    JOIN (SELECT world, form, unnest({b.skeleton_sql('form')}) AS code2 FROM cst) k ON f.world = k.world WHERE levenshtein(code, code2) <= 1""", **SND))
def near_codes(spark, sf):
    """Forms and cast names whose codes are one edit apart: the candidate step of the fuzzy match."""
    forms = world_of(nm.cleaned(b.words(spark, sf, timed=False)).filter("cap").filter(F.length("c") >= 4).select("session_id", "c")).select("world", "c").distinct()
    cast = ct.correction_cast(casts(spark, sf))
    a = forms.join(ph.code_rows(ph.with_codes(forms, "c", ph.skeleton_codes)).select("c", "code"), "c").withColumn("g", F.explode(ct._deletions(F.col("code"), 1)))
    k = cast.join(ph.code_rows(ph.with_codes(cast, "form", ph.skeleton_codes)), "form").select("world", "form", F.col("code").alias("code2"))
    k = k.withColumn("g", F.explode(ct._deletions(F.col("code2"), 1)))
    return a.join(k, ["world", "g"]).filter(F.levenshtein("code", "code2", 1) >= 0).select("world", "c", "form").distinct()


@query("fuzzy_match")
def fuzzy_match(spark, sf):
    forms = world_of(nm.cleaned(b.words(spark, sf, timed=False)).filter("cap").select("session_id", "c"))
    return ct.fuzzy_match(forms, ct.correction_cast(casts(spark, sf)), S, 1, 0.6)


def gated(spark, sf):
    common = qn.common_words(spark, sf)
    w, _, members = qn.cards_of(spark, sf, common)
    forms = world_of(members.filter("not is_phrase").select("session_id", "c"))
    cast = ct.correction_cast(casts(spark, sf))
    both = ct.combine(ct.vote(judged(w), S, 7), ct.sound_match(forms, cast, S, ph.skeleton_codes), S)
    flags = both.withColumn("flag_id", F.col("key")).withColumn("case", F.lit("M9c"))
    return w, ct.dictionary_gate(flags, nm.proper_names(w, S), common, S)


@query("combined_catches", b.with_ctes("cwords", "SELECT session_id, key, canonical, methods, vote_count FROM gated", **PARTS), bigint="vote_count")
def combined_catches(spark, sf):
    _, g = gated(spark, sf)
    return g.select("session_id", "key", "canonical", F.array_join("methods", ",").alias("methods"), "vote_count")


TIER = "CASE WHEN confident THEN 'confident' WHEN coalesce(vote_count, 0) >= 3 THEN 'best_guess' ELSE 'low' END"


def expanded(spark, sf):
    w, g = gated(spark, sf)
    return ct.expand(g, w, S, ph.skeleton_codes)


@query("canon_flags", b.with_ctes("cwords", f"SELECT session_id, seg_pos, word_index, token, key, canonical, methods, confident, {TIER} AS tier FROM sure", **PARTS))
def canon_flags(spark, sf):
    e = expanded(spark, sf)
    return e.select(*nm.AT, "token", "key", "canonical", F.array_join("methods", ",").alias("methods"), "confident", ct.canon_tier().alias("tier"))


GROUPED = """SELECT session_id, key, sum(n) AS n_occurrences, arg_min(s, (-n, pl)) AS heard, any_value(canonical) AS suggestion, any_value(confident) AS confident FROM (SELECT session_id, key,
    regexp_replace(token, '^[\\s.,?!]+|[\\s.,?!]+$', '', 'g') AS s, count(*) AS n, min((seg_pos, word_index)) AS pl, any_value(canonical) AS canonical, any_value(confident) AS confident FROM sure GROUP BY ALL) GROUP BY ALL"""
BLESSED = "SELECT 'w' || item_id % 4 AS world, lower(regexp_extract(text, '([A-Za-z]{4,})[^A-Za-z]*$', 1)) AS form, 'B' || item_id AS canonical, item_id AS ordinal FROM benchmark"


def blessed(spark, sf):
    i = F.col("item_id")
    return b.table(spark, sf, "benchmark").select(
        F.concat(F.lit("w"), (i % 4).cast("string")).alias("world"), F.lower(F.regexp_extract("text", "([A-Za-z]{4,})[^A-Za-z]*$", 1)).alias("form"),
        F.concat(F.lit("B"), i.cast("string")).alias("canonical"), i.alias("ordinal"))


@query("classified_groups", b.with_ctes("cwords", """SELECT g.session_id, g.key, n_occurrences, heard, world, coalesce(bl, suggestion) AS canonical,
    CASE WHEN bl IS NOT NULL THEN 'dictionary' WHEN confident THEN 'sound-alike' ELSE 'judge' END AS method, CASE WHEN bl IS NOT NULL OR confident THEN 'auto' ELSE 'pending' END AS action
    FROM (SELECT *, 'w' || CAST(session_id AS INTEGER) % 4 AS world FROM grouped) g LEFT JOIN (SELECT world AS bw, form, arg_max(canonical, ordinal) AS bl FROM blessed GROUP BY ALL) d ON g.world = d.bw AND g.key = d.form""",
    **PARTS, grouped=GROUPED, blessed=BLESSED), bigint="n_occurrences")
def classified_groups(spark, sf):
    groups = world_of(ct.group_catches(expanded(spark, sf), S))
    return ct.classify(groups, blessed(spark, sf)).drop("suggestion", "confident")


VSURF = """SELECT m.session_id, m.card_key, w.word AS surface, bool_or(length(w.word) % 4 = 0) AS listed FROM mem m JOIN iw w ON w.session_id = m.session_id AND w.c = m.c GROUP BY ALL"""
VERD = """SELECT session_id, card_key, CASE length(card_key) % 4 WHEN 0 THEN 'canon_wrong' WHEN 1 THEN 'inconsistent' WHEN 2 THEN 'substitution' ELSE 'fine' END AS verdict,
    upper(substr(card_key, 1, 1)) || substr(card_key, 2) AS canonical FROM (SELECT DISTINCT session_id, card_key FROM mem)"""
VFLAG = f"""SELECT session_id, card_key AS flag_id, kind AS "case", canonical, surface, key FROM (SELECT *, min(lvl) OVER (PARTITION BY session_id, card_key) AS best FROM (
    SELECT s.*, v.canonical, CASE verdict WHEN 'canon_wrong' THEN 'M9c' WHEN 'inconsistent' THEN 'M9b' WHEN 'substitution' THEN 'M9d-suspect' END AS kind, {b.clean_sql('surface')} AS key,
    CASE WHEN listed THEN 0 WHEN {b.clean_sql('surface')} <> {b.clean_sql('canonical')} THEN 1 ELSE 2 END AS lvl FROM vsurf s JOIN verd v ON s.session_id = v.session_id AND s.card_key = v.card_key
    WHERE verdict <> 'fine')) WHERE lvl = best AND kind <> 'M9d-suspect'"""


def verdict_rows(spark, sf, common=None):
    w, _, members = qn.cards_of(spark, sf, common)
    singles = members.filter("not is_phrase")
    surfaces = nm.card_occurrences(w, singles, S).groupBy("session_id", "card_key", F.col("token").alias("surface")).agg(
        F.bool_or(F.length("token") % 4 == 0).alias("listed"))
    n = F.length("card_key") % 4
    verdicts = singles.select("session_id", "card_key").distinct().withColumn("verdict", F.when(n == 0, "canon_wrong").when(n == 1, "inconsistent").when(n == 2, "substitution").otherwise("fine"))
    verdicts = verdicts.withColumn("canonical", F.concat(F.upper(F.substring("card_key", 1, 1)), F.expr("substring(card_key, 2)")))
    return w, ct.verdict_flags(verdicts, surfaces, S)


@query("verdict_flags", b.with_ctes("cwords", "SELECT * FROM vflag", **qn.CARDS, vsurf=VSURF, verd=VERD, vflag=VFLAG))
def verdict_flags(spark, sf):
    return verdict_rows(spark, sf)[1]


@query("gated_and_shielded", b.with_ctes("cwords", f"""SELECT session_id, flag_id, "case", key FROM (SELECT *, bool_or(ow) OVER (PARTITION BY session_id, flag_id) AS anyo FROM (SELECT *, {_ordinary('key')} AS ow, {_ordinary('cc')} AS oc
    FROM (SELECT *, {b.clean_sql('canonical')} AS cc FROM (SELECT DISTINCT session_id, flag_id, "case", canonical, key FROM vflag)))) WHERE NOT ("case" = 'M9c' AND (ow OR (oc AND anyo))) AND NOT ("case" = 'M9b' AND (session_id, key) IN (SELECT session_id, form FROM sessform))""",
    **qn.CARDS, vsurf=VSURF, verd=VERD, vflag=VFLAG, casts=CASTS, cst=CAST, sessform="SELECT DISTINCT session_id, form FROM mem JOIN cst ON world = 'w' || CAST(session_id AS INTEGER) % 4"))
def gated_and_shielded(spark, sf):
    common = qn.common_words(spark, sf)
    w, flags = verdict_rows(spark, sf, common)
    flags = flags.select("session_id", "flag_id", "case", "canonical", "key").distinct()
    gate = ct.dictionary_gate(flags, nm.proper_names(w, S), common, S)
    sessions = world_of(flags.select("session_id").distinct())
    protected = sessions.join(ct.correction_cast(casts(spark, sf)), "world").select("session_id", F.col("form").alias("c"))
    return ct.shield(gate, protected, S).select("session_id", "flag_id", "case", "key")


CANDS = "SELECT session_id, seg_pos, word_index, \"start\", word AS blind, c AS blind_c, 'w' || CAST(session_id AS INTEGER) % 4 AS world FROM iw WHERE cap AND length(c) >= 6"
HEARD = """SELECT k.session_id, k.seg_pos, k.word_index, translate(w.c, 'aeiou', 'eioua') AS wc, (w.word_index - k.word_index) * 300 + least(k."start", 1500) AS "offset"
    FROM cands k JOIN iw w ON k.session_id = w.session_id AND k.seg_pos = w.seg_pos AND abs(w.word_index - k.word_index) <= 2 WHERE w.c <> ''"""
GATE_PARTS = dict(iw=qn.IW, sing=qn.SING, common=qn.COMMON, casts=CASTS, cst=CAST, owner=OWNER, blessed=BLESSED, cands=CANDS, heard=HEARD,
    bl="SELECT world, form, arg_max(canonical, ordinal) AS bc FROM blessed GROUP BY ALL",
    ck="SELECT k.*, bc FROM cands k LEFT JOIN bl ON k.world = bl.world AND k.blind_c = bl.form",
    fit="""SELECT h.*, k.world, k.blind_c, (SELECT name FROM cst WHERE cst.world = k.world AND cst.form = h.wc) AS ex, abs("offset" - least(k."start", 1500)) AS far FROM heard h JOIN ck k USING (session_id, seg_pos, word_index)
       WHERE bc IS NULL AND abs("offset" - least(k."start", 1500)) <= 700""",
    tgt="""SELECT session_id, seg_pos, word_index, any_value(world) AS world, any_value(blind_c) AS blind_c, arg_min(wc, (far, "offset", wc)) AS wc FROM fit WHERE ex IS NOT NULL OR (session_id, wc) IN (SELECT session_id, c FROM sing)
       OR wc NOT IN (SELECT word FROM common) GROUP BY session_id, seg_pos, word_index""",
    codes2=f"SELECT world, name, cast_rank, unnest({b.skeleton_sql('form')}) AS code FROM cst",
    t2=f"SELECT *, (SELECT name FROM cst WHERE cst.world = t.world AND cst.form = t.wc) AS ex, {b.skeleton_sql('wc')} AS cds FROM tgt t WHERE wc <> blind_c",
    snd2="SELECT wc, t.world, arg_min(name, cast_rank) AS nm FROM (SELECT DISTINCT wc, world, unnest(cds) AS code FROM t2) t JOIN codes2 c ON t.world = c.world AND t.code = c.code GROUP BY ALL",
    dec="""SELECT session_id, seg_pos, word_index, t.world, blind_c, wc AS redecoded, coalesce(ex, nm) AS canonical, CASE WHEN ex IS NOT NULL THEN 'exact' ELSE 'dm' END AS how,
       CASE WHEN blind_c IN (SELECT word FROM common) THEN 'queued' ELSE 'auto' END AS action FROM t2 t LEFT JOIN snd2 s USING (wc, world) WHERE coalesce(ex, nm) IS NOT NULL
       UNION ALL SELECT session_id, seg_pos, word_index, world, blind_c, blind_c, bc, 'dictionary', 'auto' FROM ck WHERE bc IS NOT NULL""")


def decisions(spark, sf, words=None):
    w = c = qn.cleaned_words(spark, sf, timed=True) if words is None else words
    cands = world_of(c.filter("cap").filter(F.length("c") >= 6).select(*nm.AT, "start", F.col("word").alias("blind")))
    # the second hearing: the words around the candidate with their vowels shifted
    near = cands.select(*nm.AT, "start", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d"))
    src = c.filter("c <> ''").select("session_id", "seg_pos", F.col("word_index").alias("src"), F.translate("c", "aeiou", "eioua").alias("word"))
    heard = near.withColumn("src", F.col("word_index") + F.col("d")).join(src, ["session_id", "seg_pos", "src"]).select(
        *nm.AT, "word", (F.col("d") * 300 + F.least(F.col("start"), F.lit(1500))).alias("offset"))
    return ct.gate_decisions(cands, heard, ct.correction_cast(casts(spark, sf)), blessed(spark, sf), nm.proper_names(w, S),
                             qn.common_words(spark, sf), S, 700, 1500, ph.skeleton_codes)


@query("correction_gate", b.with_ctes("cwords", "SELECT * FROM dec", **GATE_PARTS))
def correction_gate(spark, sf):
    return decisions(spark, sf).select(*nm.AT, "world", "blind_c", tx.clean("redecoded").alias("redecoded"), "canonical", "how", "action")


@query("decision_groups", b.with_ctes("cwords", """SELECT session_id, blind_c AS key, action, count(*) AS n_occurrences, arg_min(canonical, (seg_pos, word_index)) AS canonical, arg_min(how, (seg_pos, word_index)) AS how FROM dec GROUP BY ALL""", **GATE_PARTS))
def decision_groups(spark, sf):
    return ct.group_decisions(decisions(spark, sf), S).select("session_id", "key", "action", "n_occurrences", "canonical", "how")


@query("decision_occurrences", b.with_ctes("cwords", r"""SELECT session_id, blind_c AS key, action, seg_pos, word_index, regexp_replace(blind, '^[\s.,?!]+|[\s.,?!]+$', '', 'g') AS surface FROM dec JOIN (SELECT session_id, seg_pos, word_index, blind FROM cands) USING (session_id, seg_pos, word_index)""", **GATE_PARTS))
def decision_occurrences(spark, sf):
    return ct.group_occurrences(decisions(spark, sf), S, "blind_c", "blind", ["action"])


@query("queue_sessions", b.with_ctes("cwords", """SELECT world, key, canonical, session_id, n AS n_occurrences FROM (SELECT session_id, blind_c AS key, any_value(world) AS world, count(*) AS n,
    arg_min(canonical, (seg_pos, word_index)) AS canonical FROM dec WHERE action = 'queued' GROUP BY ALL)""", **GATE_PARTS), bigint="n_occurrences")
def queue_sessions(spark, sf):
    from parley.operators.corrections import queue_sessions
    return queue_sessions(world_of(ct.group_decisions(decisions(spark, sf), S).filter("action = 'queued'")))


@query("auto_corrections", b.with_ctes("cwords", """SELECT session_id, blind_c AS transcribed, arg_min(canonical, (seg_pos, word_index)) AS correct FROM dec WHERE action = 'auto' GROUP BY ALL""", **GATE_PARTS))
def auto_corrections(spark, sf):
    return ct.auto_corrections(ct.group_decisions(decisions(spark, sf), S), ["first_seg", "first_word"])


@query("correction_queue", b.with_ctes("cwords", """SELECT world, key, canonical, count(DISTINCT session_id) AS n_sessions, sum(n) AS n_occurrences FROM (SELECT session_id, blind_c AS key, any_value(world) AS world, count(*) AS n,
    arg_min(canonical, (seg_pos, word_index)) AS canonical FROM dec WHERE action = 'queued' GROUP BY ALL) GROUP BY ALL""", **GATE_PARTS), bigint="n_occurrences")
def correction_queue(spark, sf):
    from parley.operators.corrections import queue_rollup
    g = world_of(ct.group_decisions(decisions(spark, sf), S).filter("action = 'queued'"))
    return queue_rollup(g)
