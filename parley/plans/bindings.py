"""Engine tables derived from the driver's parquet tables, each with the same rule as SQL.

No driver table holds a transcript, so lines of ``conversations`` stand for segments (timings: 300
ms a word, 200 ms between lines and a 3.5 s pause every third line) and ``events`` for irregularly
timed words, speaker turns and notes. ``CTE`` gives the SQL text of each table; ``with_ctes`` puts
the ones a query needs, dependencies included, in front of it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.scans import Next, RunSum, block_of, scan

SEGMENT_BLOCK = 65536          # positions per block of a session
TIME_BLOCK = 30 * 86_400_000_000   # microseconds per block of an event line: far below 10^5 events a block
BUCKET = 6 * 3_600_000_000     # microseconds per interval-join bucket
TURN_WIDTH = BUCKET

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seg_block(col: str = "seg_pos") -> Column:
    return block_of(col, SEGMENT_BLOCK)


def time_block(col: str = "start") -> Column:
    return block_of(col, TIME_BLOCK)


def lines(spark: SparkSession, sf: str, session: int | None = None) -> DataFrame:
    """Segments without timings; of one session only where it is named, with the filter in the scan."""
    rows = table(spark, sf, "conversations")
    return (rows if session is None else rows.filter(F.col("conv_id") == session)).select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seg_pos"),
        F.col("turn").cast("string").alias("seg_id"), (F.col("role") == "system").alias("is_gap"),
        F.col("role").alias("speaker_label"), "text", F.size(_toks("text")).cast("long").alias("n_words"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    base = lines(spark, sf)
    timed = scan(base, ["session_id"], ["seg_pos"], seg_block(), _w=RunSum(F.col("n_words"), inclusive=False))
    start = (300 * F.col("_w") + 200 * F.col("seg_pos") + 3500 * F.floor(F.col("seg_pos") / 3)).cast("long")
    return timed.withColumn("start", start).withColumn("end", start + 300 * F.col("n_words")).drop("_w")


def _toks(col: str) -> Column:
    body = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\s+"))


def _surface(raw: Column, i: Column) -> Column:
    """The ``i``-th word of a line as written; every few longer words have a capital, to act as names."""
    n = F.length(raw)
    named = (n >= 6) & ((n + i) % 3 == 0) & raw.rlike("^[a-z]")
    return F.when(named, F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, F.lit(2), n))).otherwise(raw)


def _word(raw: Column, i: Column, role: Column, seg_pos: Column, start: Column | None) -> list[Column]:
    """Columns of the ``i``-th word of a line."""
    n = F.length(raw)
    silent = (n + i) % 13 == 0
    return [_surface(raw, i).alias("word"),
            *([] if start is None else [(start + 300 * i).alias("start"), (start + 300 * i + 300).alias("end")]),
            F.when((n + i) % 17 == 0, F.lit(None)).otherwise(((n * 37 + i * 11) % 100) / F.lit(100.0)).alias("probability"),
            F.when(silent, F.lit(None)).when((i + seg_pos) % 5 == 0, F.lit("guest")).otherwise(role).alias("speaker_label"),
            F.when(silent, F.lit(0.0)).otherwise(((n * 29) % 100 + 1) / F.lit(100.0)).alias("coverage")]


def words(spark: SparkSession, sf: str, timed: bool = True) -> DataFrame:
    """One row per word."""
    if timed:
        s = segments(spark, sf)
    else:
        s = table(spark, sf, "conversations").select(
            F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seg_pos"),
            F.col("role").alias("speaker_label"), "text")
    w = s.select("session_id", "seg_pos", F.col("speaker_label").alias("_role"),
                 *([F.col("start").alias("_s")] if timed else []),
                 F.posexplode(_toks("text")).alias("word_index", "_raw"))
    return w.select("session_id", "seg_pos", "word_index", *_word(
        F.col("_raw"), F.col("word_index"), F.col("_role"), F.col("seg_pos"), F.col("_s") if timed else None))


def lines_of_words(spark: SparkSession, sf: str) -> DataFrame:
    """Segments, each with its words of ``words`` as one array in order."""
    return segments(spark, sf).select("session_id", "seg_pos", F.transform(_toks("text"), lambda raw, i: F.struct(
        i.alias("word_index"), *_word(raw, i, F.col("speaker_label"), F.col("seg_pos"), F.col("start")))).alias("words"))


def surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Segments, each with the spellings of its words as one array in order."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seg_pos"),
        F.transform(_toks("text"), _surface).alias("words"))


def timed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Events as words: [ts, ts + 10 minutes per unit of value) in microseconds since 2024."""
    e = table(spark, sf, "events")
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    length = F.round(F.col("value") * 100).cast("long") * 6_000_000
    return e.select(F.col("user_id").cast("string").alias("session_id"), "event_id", start.alias("start"),
                    (start + length).alias("end"),
                    F.concat(F.lit("k"), F.regexp_extract("props", r"(\d+)", 1)).alias("word"),
                    F.when(F.col("event_type") != "error", F.col("event_type")).alias("speaker_label"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each event up to the user's next event: exclusive speaker turns."""
    e = timed_words(spark, sf).select("session_id", "start", "event_id", F.coalesce("speaker_label", F.lit("error")).alias("speaker"))
    ended = scan(e, ["session_id"], ["start", "event_id"], time_block(), _n=Next(F.col("start")))
    return ended.select("session_id", "start",
                        F.coalesce("_n", F.col("start") + 3_600_000_000).alias("end"), "speaker").filter("end > start")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as points in time with an answer word."""
    return (timed_words(spark, sf).filter("speaker_label is null")
            .select("session_id", F.col("event_id").alias("note_id"), F.col("start").alias("at"),
                    F.concat(F.lit("k"), F.col("event_id") % 100).alias("answer")))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("profile_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def codes_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Human labels of documents as arrays of failure codes."""
    l = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    coded = F.array_compact(F.array(F.when(F.col("quality") == 0, "M1"), F.when(F.col("toxic") == 1, "M2"),
                                    F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "NotA")))
    return l.join(d, "doc_id").select(F.col("source").alias("session_id"),
                                      F.col("doc_id").alias("seg_id"), coded.alias("codes"), "n_chars", "quality", "toxic")


STOP_SQL = ", ".join(f"'{w}'" for w in tx.PHRASE_STOP)
FILLER_SQL = ", ".join(f"'{w}'" for w in tx.FILLERS)


def clean_sql(x: str) -> str:
    t = rf"regexp_replace(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), '[^a-z''’]+$', '')"
    return (rf"regexp_replace(regexp_replace(regexp_replace({t}, '^[^a-z''’]+', ''), '[''’]s?$', ''), '[^a-z]', '', 'g')")


def skeleton_sql(x: str) -> str:
    hard = f"regexp_replace(translate({x}, 'cqzvdg', 'kksftk'), '[aeiouyhw]', '', 'g')"
    soft = f"regexp_replace(translate({x}, 'cqzvdg', 'sksftk'), '[aeiouyhw]', '', 'g')"
    return (f"list_filter(CASE WHEN {hard} = {soft} THEN [{hard}] ELSE [{hard}, {soft}] END, lambda c: c <> '')")


CAP = r"'^[^\p{L}]*\p{Lu}'"

CTE: dict[str, tuple[list[str], str]] = {
    "seg_toks": ([], r"""SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS seg_pos,
        CAST(turn AS VARCHAR) AS seg_id, role = 'system' AS is_gap, role AS speaker_label, text,
        CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN CAST([] AS VARCHAR[])
             ELSE regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') END AS toks
        FROM conversations"""),
    "segments": (["seg_toks"], """SELECT session_id, seg_pos, seg_id, is_gap, speaker_label, text, n_words,
        CAST(300 * (w - n_words) + 200 * seg_pos + 3500 * (seg_pos // 3) AS BIGINT) AS "start",
        CAST(300 * w + 200 * seg_pos + 3500 * (seg_pos // 3) AS BIGINT) AS "end", toks
        FROM (SELECT *, len(toks) AS n_words,
              sum(len(toks)) OVER (PARTITION BY session_id ORDER BY seg_pos ROWS UNBOUNDED PRECEDING) AS w FROM seg_toks)"""),
    "words": (["segments"], r"""SELECT session_id, seg_pos, i AS word_index,
        CASE WHEN n >= 6 AND (n + i) % 3 = 0 AND regexp_matches(raw, '^[a-z]') THEN upper(substr(raw, 1, 1)) || substr(raw, 2) ELSE raw END AS word,
        s + 300 * i AS "start", s + 300 * i + 300 AS "end",
        CASE WHEN (n + i) % 17 = 0 THEN NULL ELSE ((n * 37 + i * 11) % 100) / 100.0 END AS probability,
        CASE WHEN (n + i) % 13 = 0 THEN NULL WHEN (i + seg_pos) % 5 = 0 THEN 'guest' ELSE role END AS speaker_label,
        CASE WHEN (n + i) % 13 = 0 THEN 0.0 ELSE ((n * 29) % 100 + 1) / 100.0 END AS coverage
        FROM (SELECT session_id, seg_pos, speaker_label AS role, "start" AS s, unnest(toks) AS raw,
              length(unnest(toks)) AS n, CAST(unnest(range(len(toks))) AS INTEGER) AS i FROM segments)"""),
    "cwords": (["words"], f"""SELECT *, {clean_sql('word')} AS c, regexp_matches(word, {CAP}) AS cap FROM words"""),
    "timed_words": ([], r"""SELECT CAST(user_id AS VARCHAR) AS session_id, event_id,
        epoch_us(ts) - 1704067200000000 AS "start",
        epoch_us(ts) - 1704067200000000 + CAST(round(value * 100) AS BIGINT) * 6000000 AS "end",
        'k' || regexp_extract(props, '(\d+)', 1) AS word,
        CASE WHEN event_type <> 'error' THEN event_type END AS speaker_label FROM events"""),
    "turns": (["timed_words"], """SELECT * FROM (SELECT session_id, "start", coalesce(lead("start") OVER
        (PARTITION BY session_id ORDER BY "start", event_id), "start" + 3600000000) AS "end", coalesce(speaker_label, 'error') AS speaker
        FROM timed_words) WHERE "end" > "start" """),
    "notes": (["timed_words"], """SELECT session_id, event_id AS note_id, "start" AS "at", 'k' || CAST(event_id % 100 AS VARCHAR) AS answer
        FROM timed_words WHERE speaker_label IS NULL"""),
    "vectors": ([], """SELECT vec_id, CAST(label AS VARCHAR) AS profile_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings"""),
    "doc_codes": ([], """SELECT source AS session_id, l.doc_id AS seg_id, list_filter([CASE WHEN quality = 0 THEN 'M1' END,
        CASE WHEN toxic = 1 THEN 'M2' END, CASE WHEN quality = 1 AND toxic = 0 THEN 'NotA' END], lambda x: x IS NOT NULL) AS codes,
        n_chars, quality, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""),
}


def with_ctes(needs: str, body: str, **extra: str) -> str:
    """``body`` behind the CTEs named in ``needs`` and their dependencies; ``extra`` go last."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in CTE[name][0]:
            add(dep)
        if name not in done:
            done.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{n} AS ({CTE[n][1]})" for n in done] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
