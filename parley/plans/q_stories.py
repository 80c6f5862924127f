"""Queries over story boundaries and regions."""

from pyspark.sql import functions as F

from parley.operators import names as nm
from parley.operators import stories as st
from parley.plans import bindings as b
from parley.plans.catalog import query

# cues that occur in the invented prose
CUES = {"START": [r"^the\b"], "END": [r"tion\.$"], "TRANSITION": [r"\bof the\b"]}
FACTS = """SELECT *, "start" - lag("end") OVER w AS gap_before, lag(seg_pos) OVER w IS NULL AS is_first, lead(seg_pos) OVER w IS NULL AS is_last,
    lower(trim(text)) = lag(lower(trim(text))) OVER w OR lower(trim(text)) = lead(lower(trim(text))) OVER w AS dup
    FROM segments WINDOW w AS (PARTITION BY session_id ORDER BY seg_pos)"""
CAND = r"""SELECT session_id, seg_pos AS pos, list_filter([CASE WHEN is_first THEN 'sentinel:rec-start' END, CASE WHEN is_last THEN 'sentinel:rec-end' END,
    CASE WHEN regexp_matches(text, '(?i)^the\b') THEN 'cue:START' END, CASE WHEN regexp_matches(text, '(?i)tion\.$') THEN 'cue:END' END,
    CASE WHEN regexp_matches(text, '(?i)\bof the\b') THEN 'cue:TRANSITION' END, CASE WHEN gap_before >= 3000 THEN printf('gap:%.1fs', gap_before / 1000.0) END,
    CASE WHEN is_gap THEN 'struct:unintelligible' END, CASE WHEN dup THEN 'struct:dup' END], lambda x: x IS NOT NULL) AS signals FROM facts"""
ZONE = """SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS zone FROM (SELECT *,
    CASE WHEN pos - lag(pos) OVER (PARTITION BY session_id ORDER BY pos) <= 1 THEN 0 ELSE 1 END AS n FROM cand WHERE len(signals) > 0)"""
ZONES = """SELECT session_id, zone, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_positions,
    list_sort(list_distinct(flatten(list(signals)))) AS signals FROM zone GROUP BY ALL"""
PARTS = dict(facts=FACTS, cand=CAND, zone=ZONE, zones=ZONES)


def candidates(spark, sf):
    return st.boundary_candidates(st.line_facts(b.segments(spark, sf), b.SEGMENT_BLOCK), 3000, 1000.0, CUES)


def lengths(spark, sf):
    return b.table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("boundary_signals", b.with_ctes("segments", "SELECT session_id, pos, array_to_string(signals, '|') AS signals FROM cand WHERE len(signals) > 0", **PARTS))
def boundary_signals(spark, sf):
    return candidates(spark, sf).select("session_id", "pos", F.array_join("signals", "|").alias("signals"))


@query("boundary_zones", b.with_ctes("segments", "SELECT session_id, zone, first_pos, last_pos, n_positions, array_to_string(signals, '|') AS signals FROM zones", **PARTS), bigint="zone")
def boundary_zones(spark, sf):
    return st.boundary_zones(candidates(spark, sf), b.SEGMENT_BLOCK, 1).withColumn("signals", F.array_join("signals", "|"))


# lines of the sessions are few, so windows stop at five lines here: three first, one last
WINDOWS = """SELECT *, CAST(n_shown > 5 AND seg_pos = hi AS BOOLEAN) AS after_elision FROM (SELECT session_id, zone, lo, hi, hi - lo + 1 AS n_shown, unnest(range(lo, hi + 1)) AS seg_pos
    FROM (SELECT session_id, zone, greatest(first_pos - 3, 0) AS lo, least(last_pos + 3, n - 1) AS hi FROM zones JOIN (SELECT session_id, count(*) AS n FROM segments GROUP BY session_id) USING (session_id)))
    WHERE n_shown <= 5 OR seg_pos < lo + 3 OR seg_pos = hi"""
SHORT = dict(most=5, head=3, tail=1)


@query("zone_windows", b.with_ctes("segments", "SELECT session_id, zone, seg_pos, after_elision FROM wins", **PARTS, wins=WINDOWS), bigint="zone")
def zone_windows(spark, sf):
    z = st.boundary_zones(candidates(spark, sf), b.SEGMENT_BLOCK, 1)
    return st.zone_windows(z, lengths(spark, sf), **SHORT).select("session_id", "zone", "seg_pos", "after_elision")


EVENTS = """SELECT session_id, seg_pos // 3 AS zone, CAST(greatest(seg_pos - n_words % 4, 0) AS BIGINT) AS pos, CASE n_words % 3 WHEN 0 THEN 'start' ELSE 'end' END AS kind
    FROM segments WHERE n_words % 3 < 2"""
WALK = """SELECT session_id, 0 AS step, CAST(NULL AS BIGINT) AS open, CAST(NULL AS BIGINT) AS last_end, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM lens
    UNION ALL SELECT w.session_id, w.step + 1,
      CASE WHEN v.kind = 'end' THEN NULL WHEN w.open IS NULL OR v.pos - 1 >= w.open THEN v.pos ELSE w.open END,
      CASE WHEN v.kind = 'end' THEN CASE WHEN w.open IS NULL THEN v.pos ELSE greatest(v.pos, w.open) END WHEN v.pos - 1 >= w.open THEN v.pos - 1 ELSE w.last_end END,
      CASE WHEN v.kind = 'end' THEN coalesce(w.open, least(coalesce(w.last_end + 1, 0), v.pos)) WHEN v.pos - 1 >= w.open THEN w.open END,
      CASE WHEN v.kind = 'end' THEN CASE WHEN w.open IS NULL THEN v.pos ELSE greatest(v.pos, w.open) END WHEN v.pos - 1 >= w.open THEN v.pos - 1 END
    FROM walk w JOIN ev v ON w.session_id = v.session_id AND v.i = w.step + 1"""
REGIONS = """SELECT session_id, s AS start_pos, e AS end_pos FROM walk WHERE s IS NOT NULL
    UNION ALL SELECT w.session_id, w.open, n - 1 FROM walk w JOIN lens l USING (session_id) WHERE w.step = l.k AND w.open IS NOT NULL
    UNION ALL SELECT session_id, 0, n - 1 FROM lens WHERE k = 0"""
STORY = dict(ev0=EVENTS, ev="SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY zone, pos, kind) AS i FROM ev0",
             lens="SELECT s.session_id, count(*) AS n, (SELECT count(*) FROM ev WHERE ev.session_id = s.session_id) AS k FROM segments s GROUP BY s.session_id",
             walk=WALK, regions=REGIONS)


def events(spark, sf):
    n = F.col("n_words")
    s = b.lines(spark, sf).filter(n % 3 < 2)
    return s.select("session_id", F.floor(F.col("seg_pos") / 3).alias("zone"), F.greatest(F.col("seg_pos") - n % 4, F.lit(0)).cast("long").alias("pos"),
                    F.when(n % 3 == 0, "start").otherwise("end").alias("kind"))


def regions(spark, sf):
    return st.assemble_stories(events(spark, sf), lengths(spark, sf), b.SEGMENT_BLOCK)


@query("story_assembly", b.with_ctes("segments", "SELECT session_id, start_pos, end_pos FROM regions", **STORY))
def story_assembly(spark, sf):
    return regions(spark, sf)


LINES = """SELECT r.session_id, r.start_pos, r.end_pos, g.seg_pos, text FROM uregions r JOIN segments g ON g.session_id = r.session_id AND g.seg_pos BETWEEN r.start_pos AND r.end_pos"""
U = dict(STORY, uregions="SELECT DISTINCT * FROM regions", lines=LINES)


def distinct_regions(spark, sf):
    return regions(spark, sf).distinct()


@query("region_views", b.with_ctes("segments", """SELECT session_id, start_pos, end_pos, seg_pos, i AS line_no, n AS n_lines, n <= 3 OR i <= 2 OR i > n - 1 AS in_view FROM
    (SELECT *, row_number() OVER (PARTITION BY session_id, start_pos, end_pos ORDER BY seg_pos) AS i, count(*) OVER (PARTITION BY session_id, start_pos, end_pos) AS n
     FROM lines WHERE trim(text) <> '')""", **U))
def region_views(spark, sf):
    lines = st.region_text(b.lines(spark, sf), distinct_regions(spark, sf), 64)
    view = st.head_tail(lines, 2, 1).select("session_id", "start_pos", "end_pos", "seg_pos", F.lit(True).alias("in_view"))
    keys = ["session_id", "start_pos", "end_pos", "seg_pos"]
    return (lines.select(*keys, "line_no", "n_lines").join(view, keys, "left").withColumn("in_view", F.coalesce("in_view", F.lit(False))))


WIND = [r"\bof the\b"]


@query("winddown_drop", b.with_ctes("segments", """SELECT session_id, start_pos, end_pos, round(f, 6) AS winddown FROM (SELECT *, min(f) OVER (PARTITION BY session_id) AS least FROM
    (SELECT session_id, start_pos, end_pos, avg(CASE WHEN regexp_matches(text, '(?i)\\bof the\\b') THEN 1.0 ELSE 0.0 END) AS f FROM lines GROUP BY ALL)) WHERE f < 0.34 OR least >= 0.34""", **U))
def winddown_drop(spark, sf):
    r = st.drop_winddown(distinct_regions(spark, sf), b.lines(spark, sf), 64, patterns=WIND)
    return r.withColumn("winddown", F.round("winddown", 6))


SEG_REGIONS = 'SELECT session_id, seg_pos AS region, CAST(seg_pos AS BIGINT) AS start_pos, CAST(seg_pos AS BIGINT) AS end_pos, CASE WHEN n_words % 5 > 0 THEN n_words % 5 // 3 END AS grp FROM segments'


@query("merge_regions", b.with_ctes("segments", """SELECT session_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY region
    ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN grp = lag(grp) OVER (PARTITION BY session_id ORDER BY region) THEN 0 ELSE 1 END AS n FROM sr)) GROUP BY session_id, run""", sr=SEG_REGIONS))
def merge_regions(spark, sf):
    s = b.lines(spark, sf)
    r = s.select("session_id", F.col("seg_pos").alias("region"), F.col("seg_pos").cast("long").alias("start_pos"), F.col("seg_pos").cast("long").alias("end_pos"))
    g = s.filter("n_words % 5 > 0").select("session_id", F.col("seg_pos").alias("region"), F.floor(F.col("n_words") % 5 / 3).alias("grp"))
    return st.merge_regions(r, g, b.SEGMENT_BLOCK)


@query("refine_starts", b.with_ctes("segments", """SELECT session_id, region, CASE WHEN new_pos >= greatest(coalesce(pe + 1, 0), start_pos - 40) AND new_pos < start_pos THEN new_pos ELSE start_pos END AS start_pos, end_pos
    FROM (SELECT *, lag(end_pos) OVER (PARTITION BY session_id ORDER BY region) AS pe, start_pos - n_words % 7 AS new_pos FROM
    (SELECT session_id, seg_pos AS region, seg_pos * 6 + 4 AS start_pos, seg_pos * 6 + 6 AS end_pos, n_words FROM segments))"""))
def refine_starts(spark, sf):
    s = b.lines(spark, sf).select("session_id", F.col("seg_pos").alias("region"), (F.col("seg_pos") * 6 + 4).alias("start_pos"),
                                     (F.col("seg_pos") * 6 + 6).alias("end_pos"), "n_words")
    moves = s.select("session_id", "region", (F.col("start_pos") - F.col("n_words") % 7).alias("new_pos"))
    return st.refine_starts(s.drop("n_words"), moves, b.SEGMENT_BLOCK)


STORIES = """SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY start_pos, end_pos) - 1 AS INTEGER) AS story_idx, CAST(end_pos AS VARCHAR) AS start_id,
    CAST(start_pos AS VARCHAR) AS end_id, start_pos, end_pos FROM uregions"""


def stories(spark, sf):
    """Distinct regions as stories with swapped ids; even and odd worlds."""
    from parley.operators.scans import block_of, running_number
    r = running_number(distinct_regions(spark, sf), ["session_id"], ["start_pos", "end_pos"], block_of("start_pos", b.SEGMENT_BLOCK), "n")
    return r.select("session_id", (F.col("n") - 1).cast("int").alias("story_idx"), F.col("end_pos").cast("string").alias("start_id"),
                    F.col("start_pos").cast("string").alias("end_id"))


@query("story_tags", b.with_ctes("segments", """SELECT g.session_id, g.seg_pos, max(story_idx) AS story_idx FROM segments g LEFT JOIN sto s ON g.session_id = s.session_id
    AND g.seg_pos BETWEEN s.start_pos AND s.end_pos GROUP BY ALL""", **U, sto=STORIES))
def story_tags(spark, sf):
    s = b.lines(spark, sf)
    return st.tag_stories(s, stories(spark, sf), 64).select("session_id", "seg_pos", "story_idx")


@query("story_labels", b.with_ctes("seg_toks", """SELECT session_id, n AS n_stories, worlds, CASE WHEN title IS NOT NULL THEN title || CASE WHEN n > 1 THEN ' + ' || (n - 1) || ' more' ELSE '' END ||
    CASE WHEN worlds <> '' THEN ' · ' || worlds ELSE '' END WHEN worlds <> '' THEN worlds || CASE WHEN o = 0 THEN '' WHEN o = 1 THEN ' + 1 original' ELSE ' + ' || o || ' originals' END
    WHEN n = 1 THEN '1 story' ELSE n || ' stories' END AS label FROM (SELECT session_id, count(*) AS n, count(*) FILTER (world = '') AS o, arg_min(title, seg_pos) FILTER (title <> '') AS title,
    coalesce((SELECT string_agg(world, ' · ' ORDER BY f) FROM (SELECT world, min(seg_pos) AS f FROM st i WHERE i.session_id = st.session_id AND world <> '' GROUP BY world)), '') AS worlds FROM st GROUP BY session_id)""",
    st="""SELECT session_id, seg_pos, CASE WHEN len(toks) % 4 = 0 AND CAST(session_id AS INTEGER) % 2 = 0 THEN substr(text, 1, 10) ELSE '' END AS title0, trim(CASE WHEN len(toks) % 4 = 0 AND CAST(session_id AS INTEGER) % 2 = 0 THEN 'T' || len(toks) ELSE '' END) AS title,
       CASE WHEN len(toks) % 3 = 0 THEN 'W' || len(toks) % 5 ELSE '' END AS world FROM seg_toks"""))
def story_labels(spark, sf):
    s = b.lines(spark, sf)
    n = F.col("n_words")
    made = s.select("session_id", F.col("seg_pos").alias("story_idx"),
                    F.when((n % 4 == 0) & (F.col("session_id").cast("int") % 2 == 0), F.concat(F.lit("T"), n.cast("string"))).alias("title"),
                    F.when(n % 3 == 0, F.concat(F.lit("W"), (n % 5).cast("string"))).alias("world"))
    return st.story_labels(made)


@query("story_names", b.with_ctes("cwords", """SELECT session_id, story_idx, name, row_number() OVER (PARTITION BY session_id, story_idx ORDER BY name) AS rank FROM (SELECT DISTINCT g.session_id, g.story_idx, c AS name FROM
    (SELECT g.session_id, g.seg_pos, max(story_idx) AS story_idx FROM segments g JOIN sto s ON g.session_id = s.session_id AND g.seg_pos BETWEEN s.start_pos AND s.end_pos GROUP BY ALL) g
    JOIN cwords w ON w.session_id = g.session_id AND w.seg_pos = g.seg_pos WHERE cap)""", **U, sto=STORIES))
def story_names(spark, sf):
    tagged = st.tag_stories(b.lines(spark, sf), stories(spark, sf), 64)
    names = nm.cleaned(b.words(spark, sf, timed=False)).filter("cap").select("session_id", "seg_pos", F.col("c").alias("surface"))
    return st.story_names(tagged, names)


@query("region_samples", b.with_ctes("segments", """SELECT session_id, start_pos, end_pos, seg_pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id, start_pos, end_pos ORDER BY seg_pos) AS i,
    count(*) OVER (PARTITION BY session_id, start_pos, end_pos) AS n FROM lines WHERE trim(text) <> '') WHERE n <= 3 OR i = 1 OR i = n OR i - 1 = n // 2""", **U))
def region_samples(spark, sf):
    lines = st.region_text(b.lines(spark, sf), distinct_regions(spark, sf), 64)
    return st.head_mid_tail(lines, 1, 1, 1).select("session_id", "start_pos", "end_pos", "seg_pos")
