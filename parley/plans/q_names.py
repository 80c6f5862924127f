"""Queries over names. The phonetic key is the consonant skeleton, which SQL can state too."""

import re

from pyspark.sql import functions as F

from parley.functions import phonetic as ph
from parley.functions import text as tx
from parley.operators import names as nm
from parley.plans import bindings as b
from parley.plans.catalog import query
from parley.session import staged

S = ["session_id"]
COMMON = f"SELECT w AS word FROM (SELECT {b.clean_sql('t')} AS w FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS t FROM documents)) GROUP BY w HAVING w <> '' AND count(*) >= 20"
SING = "SELECT DISTINCT session_id, c FROM iw WHERE cap AND NOT initial AND length(c) >= 4"
IW = r"""SELECT *, coalesce(regexp_matches(lag(word) OVER (PARTITION BY session_id, seg_pos ORDER BY word_index), '[.!?…]$|[.!?]"$'), true) AS initial,
    lead(c) OVER (PARTITION BY session_id, seg_pos ORDER BY word_index) AS c2, lead(word) OVER (PARTITION BY session_id, seg_pos ORDER BY word_index) AS word2 FROM cwords"""
PHR = f"""SELECT p.session_id, p.c, p.c2, p.n FROM (SELECT session_id, c, c2, count(*) AS n FROM iw WHERE c <> '' AND c2 <> '' AND c NOT IN ({b.STOP_SQL}) GROUP BY ALL) p
    JOIN (SELECT session_id, c, count(*) AS u FROM iw GROUP BY ALL) u ON p.session_id = u.session_id AND p.c2 = u.c
    WHERE p.n >= 2 AND p.n / u.u >= 0.5 AND (p.session_id, p.c2) IN (SELECT session_id, c FROM sing)"""
PEOPLE = "SELECT item_id AS person_id, regexp_extract(text, '([A-Za-z]{6,})', 1) AS canonical FROM benchmark"
ALIASES = "SELECT item_id AS person_id, regexp_extract(text, '([A-Za-z]{4,})[^A-Za-z]*$', 1) AS token FROM benchmark"
ROSTER = dict(people=PEOPLE, aliases=ALIASES, pform=f"SELECT *, {b.clean_sql('canonical')} AS form FROM people", aform=f"SELECT *, {b.clean_sql('token')} AS form FROM aliases",
              pcode=f"SELECT DISTINCT person_id, unnest({b.skeleton_sql('form')}) AS code FROM pform")


def common_words(spark, sf):
    """Frequent words of the documents, written, since detectors look them up several times."""
    return staged(frequent_words(b.table(spark, sf, "documents")))


def frequent_words(documents):
    """Words used twenty times or more, cleaned once per spelling."""
    spelled = documents.select(F.explode(F.split("text", r"\s+")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    words = spelled.select(tx.clean("t").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    # a test of the word alone would be pushed below both counts, and every token cleaned for it
    return words.filter(F.when(F.col("word") != "", F.col("n")) >= 20).select("word")


def cleaned_words(spark, sf, timed=False):
    """Words with their cleaned forms, written once: every detector reads them several times.

    Without times their neighbours are written too; of the timed ones only one step asks for those.
    """
    w = b.words(spark, sf, timed=timed)
    return staged(nm.cleaned(w) if timed else nm.beside(w))


def roster(spark, sf):
    bench = b.table(spark, sf, "benchmark")
    people = bench.select(F.col("item_id").alias("person_id"), F.regexp_extract("text", "([A-Za-z]{6,})", 1).alias("canonical"))
    return people, bench.select(F.col("item_id").alias("person_id"), F.regexp_extract("text", "([A-Za-z]{4,})[^A-Za-z]*$", 1).alias("token"))


@query("proper_names", b.with_ctes("cwords", "SELECT session_id, c FROM sing", iw=IW, sing=SING))
def proper_names(spark, sf):
    return nm.proper_names(b.words(spark, sf, timed=False), S)


@query("name_phrases", b.with_ctes("cwords", "SELECT * FROM phr", iw=IW, sing=SING, phr=PHR))
def name_phrases(spark, sf):
    w = cleaned_words(spark, sf)
    return nm.name_phrases(w, nm.proper_names(w, S), S)


@query("common_forms", b.with_ctes("cwords", """SELECT c, c IN (SELECT word FROM common) OR (c LIKE '%s' AND substr(c, 1, length(c) - 1) IN (SELECT word FROM common)) AS is_common,
    c IN (SELECT word FROM common) AS is_listed FROM (SELECT DISTINCT c FROM cwords WHERE c <> '')""", common=COMMON))
def common_forms(spark, sf):
    forms = staged(b.words(spark, sf, timed=False).select("word").distinct().select(tx.clean("word").alias("c")).filter("c <> ''").distinct())
    common = common_words(spark, sf)
    return nm.flag_common(nm.flag_common(forms, common), common, plural=False, name="is_listed")


@query("skeleton_codes", b.with_ctes("cwords", f"SELECT DISTINCT c, array_to_string({b.skeleton_sql('c')}, ',') AS codes FROM cwords WHERE c <> ''"))
def skeleton_codes(spark, sf):
    w = b.words(spark, sf, timed=False).select(tx.clean("word").alias("c"))
    return ph.with_codes(w, "c", ph.skeleton_codes).withColumn("codes", F.array_join("codes", ","))


@query("metaphone_codes")
def metaphone_codes(spark, sf):
    w = b.words(spark, sf, timed=False).select(tx.clean("word").alias("c"))
    return ph.with_codes(w, "c").withColumn("codes", F.array_join("codes", ","))


@query("roster_problems", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ROSTER.items()) + f""" SELECT DISTINCT token, 'redundant' AS problem FROM
    (SELECT token, unnest({b.skeleton_sql('form')}) AS code FROM aform WHERE form <> '') WHERE code IN (SELECT code FROM pcode)""")
def roster_problems(spark, sf):
    return nm.roster_problems(*roster(spark, sf), codes=ph.skeleton_codes)


@query("family_names", b.with_ctes("cwords", """SELECT w.session_id, w.seg_pos, w.word_index, w.word, match_type, array_to_string(ids, ',') AS person_ids FROM cwords w JOIN hit h ON w.c = h.c WHERE cap""",
    **ROSTER, v="SELECT DISTINCT c FROM cwords WHERE c <> '' AND c NOT IN (SELECT form FROM pform)", vc=f"SELECT c, unnest({b.skeleton_sql('c')}) AS code FROM v",
    snd="SELECT c, 'phonetic' AS match_type, list_sort(list_distinct(list(person_id))) AS ids FROM vc JOIN pcode USING (code) GROUP BY c",
    hit="""SELECT * FROM snd UNION ALL SELECT c, 'alias', list_sort(list_distinct(list(person_id))) FROM v JOIN aform ON c = form WHERE c NOT IN (SELECT c FROM snd) GROUP BY c"""))
def family_names(spark, sf):
    f = nm.family_names(cleaned_words(spark, sf), *roster(spark, sf), codes=ph.skeleton_codes)
    return f.select(*nm.AT, "word", "match_type", F.array_join("person_ids", ",").alias("person_ids"))


FORMS = dict(**ROSTER, occ="SELECT * FROM cwords WHERE cap AND length(c) >= 4 AND c NOT IN (SELECT form FROM pform) AND c NOT IN (SELECT form FROM aform) AND c NOT IN (SELECT c FROM rost)")
FORMS["occ0"] = "SELECT DISTINCT c FROM cwords WHERE cap AND length(c) >= 4"
FORMS["rost"] = f"SELECT c FROM (SELECT c, unnest({b.skeleton_sql('c')}) AS code FROM occ0) WHERE code IN (SELECT code FROM pcode)"
CLUSTER = dict(edge=f"SELECT DISTINCT session_id, c, unnest({b.skeleton_sql('c')}) AS code FROM {{src}}",
               walk="""SELECT session_id, c AS src, c FROM edge UNION SELECT w.session_id, w.src, e2.c FROM walk w JOIN edge e1 ON w.session_id = e1.session_id AND w.c = e1.c
                   JOIN edge e2 ON e1.session_id = e2.session_id AND e1.code = e2.code""",
               clu="SELECT session_id, src AS c, min(c) AS cluster_id FROM walk GROUP BY ALL")
_order = ["people", "aliases", "pform", "aform", "pcode", "occ0", "rost", "occ"]
M9B = {k: FORMS[k] for k in _order} | {"edge": CLUSTER["edge"].format(src="occ"), "walk": CLUSTER["walk"], "clu": CLUSTER["clu"], "common": COMMON,
    "fc": "SELECT session_id, c, count(*) AS n, arg_min(word, (seg_pos, word_index)) AS surface FROM occ GROUP BY ALL",
    "cf": """SELECT f.*, cluster_id, f.c IN (SELECT word FROM common) OR (f.c LIKE '%s' AND substr(f.c, 1, length(f.c) - 1) IN (SELECT word FROM common)) AS com FROM fc f JOIN clu k ON f.session_id = k.session_id AND f.c = k.c""",
    "tot": """SELECT session_id, cluster_id, count(*) AS n_spellings, sum(n) AS n_occurrences, max(n) AS top, arg_max(c, n) AS mc FROM cf GROUP BY ALL HAVING count(*) > 1 AND bool_or(NOT com)""",
    "flags": """SELECT o.session_id, o.seg_pos, o.word_index, o.word, o.c, t.cluster_id, t.n_spellings, t.n_occurrences, CASE WHEN top * 2 > n_occurrences THEN mc END AS majority_form
        FROM occ o JOIN cf f ON o.session_id = f.session_id AND o.c = f.c JOIN tot t ON f.session_id = t.session_id AND f.cluster_id = t.cluster_id
        WHERE NOT (top * 2 > n_occurrences AND o.c = mc)"""}


def m9b(spark, sf, words=None):
    people, aliases = roster(spark, sf)
    return nm.inconsistent_names(cleaned_words(spark, sf) if words is None else words, S, common_words(spark, sf), people, aliases, codes=ph.skeleton_codes)


@query("name_clusters", b.with_ctes("cwords", "SELECT * FROM clu", edge=CLUSTER["edge"].format(src="(SELECT * FROM cwords WHERE cap AND length(c) >= 4)"), walk=CLUSTER["walk"], clu=CLUSTER["clu"]))
def name_clusters(spark, sf):
    w = nm.cleaned(b.words(spark, sf, timed=False)).filter("cap and length(c) >= 4")
    return nm.name_clusters(w.select("session_id", "c"), S, ph.skeleton_codes)


@query("inconsistent_names", b.with_ctes("cwords", "SELECT * FROM flags", **M9B), bigint="n_occurrences")
def inconsistent_names(spark, sf):
    flags, _ = m9b(spark, sf)
    return flags.select(*nm.AT, "word", "c", "cluster_id", "n_spellings", "n_occurrences", "majority_form")


@query("inconsistent_spellings", b.with_ctes("cwords", """SELECT f.session_id, f.cluster_id, f.c, f.n, CASE WHEN top * 2 > n_occurrences THEN top END AS majority_count
    FROM cf f JOIN tot t ON f.session_id = t.session_id AND f.cluster_id = t.cluster_id""", **M9B))
def inconsistent_spellings(spark, sf):
    _, spellings = m9b(spark, sf)
    return spellings.select("session_id", "cluster_id", "c", "n", "majority_count")


@query("inconsistent_names_by_sound")
def inconsistent_names_by_sound(spark, sf):
    people, aliases = roster(spark, sf)
    flags, _ = nm.inconsistent_names(cleaned_words(spark, sf), S, common_words(spark, sf), people, aliases)
    return flags.select(*nm.AT, "word", "c", "cluster_id", "n_spellings", "n_occurrences", "majority_form")


CARDS = {"iw": IW, "sing": SING, "phr": PHR, "prt": "SELECT session_id, c FROM phr UNION SELECT session_id, c2 FROM phr",
    "alone": "SELECT * FROM sing WHERE (session_id, c) NOT IN (SELECT session_id, c FROM prt)",
    "edge": CLUSTER["edge"].format(src="alone"), "walk": CLUSTER["walk"], "clu": CLUSTER["clu"], "common": COMMON,
    "roots": "SELECT e.session_id, code, min(cluster_id) AS cluster_id FROM edge e JOIN clu k ON e.session_id = k.session_id AND e.c = k.c GROUP BY ALL",
    "oth": """SELECT DISTINCT session_id, c FROM iw WHERE length(c) >= 4 AND c NOT IN (SELECT word FROM common) AND (session_id, c) NOT IN (SELECT session_id, c FROM prt)
        AND (session_id, c) NOT IN (SELECT session_id, c FROM sing)""",
    "oc": f"SELECT session_id, c, unnest({b.skeleton_sql('c')}) AS code, unnest(range(len({b.skeleton_sql('c')}))) AS r FROM oth",
    "mem": """SELECT session_id, c, cluster_id AS card_key FROM clu UNION ALL SELECT o.session_id, o.c, arg_min(cluster_id, r) FROM oc o JOIN roots t ON o.session_id = t.session_id AND o.code = t.code GROUP BY ALL""",
    "cards0": """SELECT w.session_id, card_key, false AS is_phrase, count(*) AS n, count(DISTINCT w.c) AS n_forms, count(DISTINCT word) AS n_surfaces FROM iw w JOIN mem m ON w.session_id = m.session_id AND w.c = m.c GROUP BY ALL
        UNION ALL SELECT w.session_id, w.c || ' ' || w.c2, true, count(*), 1, count(DISTINCT word || ' ' || word2) FROM iw w JOIN phr p ON w.session_id = p.session_id AND w.c = p.c AND w.c2 = p.c2 GROUP BY ALL""",
    "cards": "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, card_key) AS card_id FROM cards0"}


def cards_of(spark, sf, common=None):
    """(words, cards, members); ``common`` is the word list, where the caller needs it too."""
    w = cleaned_words(spark, sf)
    common = common_words(spark, sf) if common is None else common
    return (w, *nm.name_cards(w, S, common, codes=ph.skeleton_codes))


@query("name_cards", b.with_ctes("cwords", "SELECT * FROM cards", **CARDS))
def name_cards(spark, sf):
    return cards_of(spark, sf)[1]


STORY = ["session_id", "story_idx"]


def story_words(spark, sf):
    """Words of stories of three lines; every seventh line is outside all stories."""
    w = cleaned_words(spark, sf).filter(F.col("seg_pos") % 7 < 6)
    return w.withColumn("story_idx", F.floor(F.col("seg_pos") / 3).cast("int"))


def per_story(sql):
    """The same SQL with each story as a session of its own."""
    renamed = re.sub(r"(?<![a-z_])words AS \(", "all_words AS (", sql, count=1)
    own = "words AS (SELECT * REPLACE (session_id || '#' || seg_pos // 3 AS session_id) FROM all_words WHERE seg_pos % 7 < 6),\ncwords AS ("
    return renamed.replace("cwords AS (", own, 1)


def story_key(df):
    return df.withColumn("session_id", F.concat_ws("#", *STORY)).drop("story_idx")


@query("story_name_cards", per_story(b.with_ctes("cwords", "SELECT * FROM cards", **CARDS)))
def story_name_cards(spark, sf):
    return story_key(nm.name_cards(story_words(spark, sf), STORY, common_words(spark, sf), codes=ph.skeleton_codes)[0])


@query("story_card_occurrences", per_story(b.with_ctes("cwords", """SELECT w.session_id, seg_pos, word_index, card_key, false AS is_phrase, word AS token FROM iw w JOIN mem m ON w.session_id = m.session_id AND w.c = m.c
    UNION ALL SELECT w.session_id, seg_pos, word_index, w.c || ' ' || w.c2, true, word || ' ' || word2 FROM iw w JOIN phr p ON w.session_id = p.session_id AND w.c = p.c AND w.c2 = p.c2""", **CARDS)))
def story_card_occurrences(spark, sf):
    w = story_words(spark, sf)
    _, members = nm.name_cards(w, STORY, common_words(spark, sf), codes=ph.skeleton_codes)
    return story_key(nm.card_occurrences(w, members, STORY).drop("c"))


@query("card_occurrences", b.with_ctes("cwords", """SELECT w.session_id, seg_pos, word_index, card_key, false AS is_phrase, word AS token FROM iw w JOIN mem m ON w.session_id = m.session_id AND w.c = m.c
    UNION ALL SELECT w.session_id, seg_pos, word_index, w.c || ' ' || w.c2, true, word || ' ' || word2 FROM iw w JOIN phr p ON w.session_id = p.session_id AND w.c = p.c AND w.c2 = p.c2""", **CARDS))
def card_occurrences(spark, sf):
    w, _, members = cards_of(spark, sf)
    return nm.card_occurrences(w, members, S).drop("c")


@query("card_examples", b.with_ctes("cwords", """SELECT session_id, card_key, seg_pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id, card_key ORDER BY seg_pos) AS rank FROM (SELECT DISTINCT w.session_id, m.card_key, seg_pos
    FROM iw w JOIN (SELECT * FROM mem UNION ALL SELECT session_id, c, c || ' ' || c2 FROM phr) m ON w.session_id = m.session_id AND w.c = m.c AND (m.card_key NOT LIKE '% %' OR w.c || ' ' || w.c2 = m.card_key))) WHERE rank <= 3""", **CARDS))
def card_examples(spark, sf):
    w, _, members = cards_of(spark, sf)
    occ = nm.card_occurrences(w, members, S)
    return nm.card_examples(occ, b.lines(spark, sf), S).select("session_id", "card_key", "seg_pos", "rank")


@query("find_spellings", b.with_ctes("cwords", """SELECT w.session_id, seg_pos, word_index, t AS cleaned FROM line w JOIN (SELECT DISTINCT t, string_split(t, ' ') AS parts FROM key) ON c = parts[1] AND list_slice(cs, spot, spot + len(parts) - 1) = parts""",
    line="SELECT a.*, cs FROM (SELECT session_id, seg_pos, word_index, c, row_number() OVER (PARTITION BY session_id, seg_pos ORDER BY word_index) AS spot FROM cwords) a JOIN (SELECT session_id, seg_pos, list(c ORDER BY word_index) AS cs FROM cwords GROUP BY ALL) USING (session_id, seg_pos)",
    toks="SELECT list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda t: " + b.clean_sql("t") + "), lambda t: t <> '') AS t FROM benchmark",
    key="SELECT unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')))) AS t FROM toks"))
def find_spellings(spark, sf):
    clean = F.filter(F.transform(F.split("text", r"\s+"), tx.clean), lambda x: x != "")
    def runs(n):
        return F.filter(F.transform("t", lambda x, i: F.when(i <= F.size("t") - n, F.array_join(F.slice("t", i + 1, n), " "))), lambda x: x.isNotNull())
    key = b.table(spark, sf, "benchmark").select(clean.alias("t")).select(F.explode(F.concat(runs(1), runs(2), runs(4))).alias("cleaned"))
    return nm.find_spellings(b.surfaces(spark, sf), key)
