"""Readers of per-session JSON artifacts: sessions/<session_id>/<file>.json.

Every reader takes a glob over all sessions and reads them in one scan with a fixed schema; the
session id is the name of the folder a file lies in.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRECTION = "array<struct<stage:string,`from`:string,`to`:string>>"
SPEAKER = "struct<label:string,coverage:double,source:string>"
TRANSCRIPT = f"""segments array<struct<id:string,start:double,end:double,text:string,_source:string,_story:int,_speaker:{SPEAKER},
  no_speech_prob:double,avg_logprob:double,compression_ratio:double,temperature:double,
  words:array<struct<word:string,start:double,end:double,probability:double,_speaker:{SPEAKER},_original:string,_corrections:{CORRECTION},_align_conf:double>>>>,
  _stories array<struct<index:int,start_id:string,end_id:string,title:string,world:string>>,
  _processing array<struct<stage:string,status:string,duration_seconds:double,error:string,timestamp:string>>,
  audio struct<duration_seconds:double>"""
TURNS = "segments array<struct<start:double,end:double,speaker:string>>"
VECTORS = "speakers map<string,struct<vector:array<double>,num_segments:int,total_duration_s:double>>"
PROFILES = """profiles array<struct<id:string,name:string,role:string,centroid:array<double>,created:string,updated:string,
  embeddings:array<struct<session_id:string,source_speaker_key:string,vector:array<double>>>,
  variants:array<struct<session_id:string,source_speaker_key:string,vector:array<double>>>>>"""
IDENTIFICATIONS = """session_id string, identified_at string, identifications array<struct<speaker_key:string,status:string,profile_id:string,
  profile_name:string,confidence:double>>"""
LABELS = "labels array<struct<segmentId:string,code:string,codes:array<string>,createdAt:string,updatedAt:string>>"
NOTES = "notes array<struct<id:string,segmentId:string,wordIndex:int,wordText:string,wordStart:double,text:string>>"
VERDICTS = "verdicts array<struct<type:string,name:string,cleaned:string,cleaned_at_review:array<string>,at:string>>"
META = "note string, validationStatus string, original_filename string"
PENDING = """pending array<struct<world:string,story_id:int,heard:string,heard_cleaned:string,canonical:string,method:string,action:string,
  occurrences:array<struct<segment_id:string,word_index:int,start:double,token:string>>>>"""
ROSTER = "people array<struct<id:string,canonical:string,role:string>>, aliases array<struct<token:string,person_id:string>>"
LIBRARY = "entries array<struct<canonical:string,category:string,variants:array<string>,aliases:array<string>>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file with its session id."""
    df = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    return df.withColumn("session_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all transcripts; ids that are no integer mark injected gaps."""
    s = _read(spark, path, TRANSCRIPT).select("session_id", F.posexplode("segments").alias("seg_pos", "s"))
    return s.select("session_id", "seg_pos", F.col("s.id").alias("seg_id"), (~F.col("s.id").rlike(r"^-?\d+$")).alias("is_gap"),
                    "s.start", "s.end", "s.text", F.col("s._source").alias("source"), F.col("s._story").alias("story_idx"),
                    F.col("s._speaker.label").alias("speaker_label"), F.col("s._speaker.source").alias("speaker_source"),
                    "s.no_speech_prob", "s.avg_logprob", "s.compression_ratio", "s.temperature")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of all transcripts; ``has_speaker`` tells enriched words from never-enriched ones."""
    s = _read(spark, path, TRANSCRIPT).select("session_id", F.posexplode("segments").alias("seg_pos", "s"))
    w = s.select("session_id", "seg_pos", F.col("s.id").alias("seg_id"), F.posexplode("s.words").alias("word_index", "w"))
    return w.select("session_id", "seg_pos", "seg_id", "word_index", "w.word", "w.start", "w.end", "w.probability",
                    F.col("w._speaker").isNotNull().alias("has_speaker"), F.col("w._speaker.label").alias("speaker_label"),
                    F.col("w._speaker.coverage").alias("coverage"), F.col("w._original").alias("original"),
                    F.col("w._corrections").alias("corrections"), F.col("w._align_conf").alias("align_conf"))


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    t = _read(spark, path, TRANSCRIPT).select("session_id", F.explode("_stories").alias("s"))
    return t.select("session_id", F.col("s.index").alias("story_idx"), "s.start_id", "s.end_id", "s.title", "s.world")


def read_processing(spark: SparkSession, path: str) -> DataFrame:
    t = _read(spark, path, TRANSCRIPT).select("session_id", F.posexplode("_processing").alias("stage_no", "p"))
    return t.select("session_id", "stage_no", "p.stage", "p.status", "p.duration_seconds", "p.error")


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRANSCRIPT).select("session_id", "audio.duration_seconds")


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TURNS).select("session_id", F.explode("segments").alias("t")).select("session_id", "t.start", "t.end", "t.speaker")


def read_speaker_vectors(spark: SparkSession, path: str) -> DataFrame:
    v = _read(spark, path, VECTORS).select("session_id", F.explode("speakers").alias("speaker_key", "v"))
    return v.select("session_id", "speaker_key", "v.vector", "v.num_segments", F.col("v.total_duration_s").alias("total_duration"))


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, profile_vectors, voice_variants)"""
    p = spark.read.schema(PROFILES).json(path, multiLine=True, mode="FAILFAST").select(F.posexplode("profiles").alias("rank", "p"))
    def held(field: str) -> DataFrame:
        return p.select(F.col("p.id").alias("profile_id"), F.explode(f"p.{field}").alias("e")).select(
            "profile_id", "e.session_id", F.col("e.source_speaker_key").alias("speaker_key"), "e.vector")
    people = p.select(F.col("p.id").alias("profile_id"), "rank", "p.name", "p.role", "p.centroid", "p.updated")
    return people, held("embeddings"), held("variants")


def read_identifications(spark: SparkSession, path: str) -> DataFrame:
    i = spark.read.schema(IDENTIFICATIONS).json(path, multiLine=True, mode="FAILFAST").select("session_id", "identified_at", F.posexplode("identifications").alias("ordinal", "i"))
    return i.select("session_id", "identified_at", "ordinal", "i.speaker_key", "i.status", "i.profile_id", "i.confidence")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with codes; files written before codes were lists are read alike."""
    from parley.operators.labels import normalise
    l = _read(spark, path, LABELS).select("session_id", F.explode("labels").alias("l"))
    return normalise(l.select("session_id", F.col("l.segmentId").alias("seg_id"), "l.code", "l.codes"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    n = _read(spark, path, NOTES).select("session_id", F.explode("notes").alias("n"))
    return n.select("session_id", F.col("n.id").alias("note_id"), F.col("n.segmentId").alias("seg_id"), F.col("n.wordIndex").alias("word_index"),
                    F.col("n.wordText").alias("word_text"), F.col("n.wordStart").alias("word_start"), "n.text")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    v = _read(spark, path, VERDICTS).select("session_id", F.explode("verdicts").alias("v"))
    return v.select("session_id", "v.type", "v.name", "v.cleaned", "v.cleaned_at_review")


def read_session_meta(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, META).select("session_id", "note", F.col("validationStatus").alias("validation_status"), "original_filename")


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """Waiting corrections, one row per occurrence."""
    g = _read(spark, path, PENDING).select("session_id", F.explode("pending").alias("g"))
    return g.select("session_id", "g.world", F.col("g.story_id").alias("story_idx"), F.col("g.heard_cleaned").alias("key"), "g.heard", "g.canonical",
                    "g.method", F.explode("g.occurrences").alias("o")).select("*", F.col("o.segment_id").alias("seg_id"), "o.word_index", "o.start", "o.token").drop("o")


def read_roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    r = spark.read.schema(ROSTER).json(path, multiLine=True, mode="FAILFAST")
    people = r.select(F.explode("people").alias("p")).select(F.col("p.id").alias("person_id"), "p.canonical", "p.role")
    return people, r.select(F.explode("aliases").alias("a")).select("a.person_id", "a.token")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    l = spark.read.schema(LIBRARY).json(path, multiLine=True, mode="FAILFAST").select(F.posexplode("entries").alias("entry_pos", "e"))
    return l.select("entry_pos", "e.canonical", "e.category", "e.variants", "e.aliases")
