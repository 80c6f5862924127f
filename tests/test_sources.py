"""JSON readers, written tables and the intake stream, on files in a scratch folder."""

import json

from parley.operators import incremental as inc
from parley.sources import json_artifacts as ja
from parley.sources import tables
from parley.streaming.intake import intake

TRANSCRIPT = {
    "segments": [
        {"id": 0, "start": 0.0, "end": 1.0, "text": " Hello there", "_speaker": {"label": "A", "source": "dominant"},
         "words": [{"word": " Hello", "start": 0.0, "end": 0.5, "probability": 0.9, "_speaker": {"label": None, "coverage": 0.0}},
                   {"word": " there", "start": 0.5, "end": 1.0}]},
        {"id": "gap_1.500", "start": 1.5, "end": 2.0, "text": "[unintelligible]", "words": [], "_source": "diarization_gap"}],
    "_stories": [{"index": 0, "start_id": 0, "end_id": "gap_1.500", "title": "T", "world": "W"}],
    "_processing": [{"stage": "x", "status": "error", "duration_seconds": 1.5}], "audio": {"duration_seconds": 2.5}}


def put(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(obj))


def test_readers(spark, tmp_path):
    for sid in ("20260101-000001", "20260101-000002"):
        d = tmp_path / sid
        put(d / "transcript.json", TRANSCRIPT)
        put(d / "turns.json", {"segments": [{"start": 0.0, "end": 1.0, "speaker": "SPEAKER_00"}]})
        put(d / "vectors.json", {"speakers": {"SPEAKER_00": {"vector": [1.0, 0.0], "num_segments": 2, "total_duration_s": 3.5}}})
        put(d / "labels.json", {"labels": [{"segmentId": 0, "code": "M1"}, {"segmentId": "gap_1.500", "codes": ["M8", "M3"]}]})
        put(d / "notes.json", {"notes": [{"id": "n", "segmentId": 0, "wordIndex": 1, "wordText": "there", "wordStart": 0.5, "text": "their"}]})
        put(d / "verdicts.json", {"verdicts": [{"type": "correct", "cleaned": "hello"}]})
    at = str(tmp_path / "*" / "{}.json")
    segs = ja.read_segments(spark, at.format("transcript"))
    assert {(r.session_id, r.seg_id, r.is_gap, r.speaker_label) for r in segs.collect()} == {
        (s, i, g, l) for s in ("20260101-000001", "20260101-000002") for i, g, l in (("0", False, "A"), ("gap_1.500", True, None))}
    w = {r.word_index: r for r in ja.read_words(spark, at.format("transcript")).filter("session_id = '20260101-000001'").collect()}
    assert len(w) == 2 and w[0].has_speaker and w[0].coverage == 0.0 and not w[1].has_speaker and w[1].probability is None
    assert ja.read_stories(spark, at.format("transcript")).first().end_id == "gap_1.500"
    assert ja.read_processing(spark, at.format("transcript")).first().status == "error"
    assert ja.read_durations(spark, at.format("transcript")).first().duration_seconds == 2.5
    assert ja.read_turns(spark, at.format("turns")).count() == 2
    v = ja.read_speaker_vectors(spark, at.format("vectors")).first()
    assert (v.speaker_key, v.vector, v.num_segments) == ("SPEAKER_00", [1.0, 0.0], 2)
    assert {tuple(r.codes) for r in ja.read_labels(spark, at.format("labels")).collect()} == {("M1",), ("M8", "M3")}
    assert ja.read_notes(spark, at.format("notes")).first().word_start == 0.5
    assert ja.read_verdicts(spark, at.format("verdicts")).first().cleaned == "hello"


def test_global_files(spark, tmp_path):
    put(tmp_path / "p.json", {"profiles": [{"id": "p", "name": "N", "role": "r", "centroid": [1.0], "embeddings": [{"session_id": "s", "source_speaker_key": "k", "vector": [1.0]}], "variants": []}]})
    people, held, variants = ja.read_profiles(spark, str(tmp_path / "p.json"))
    assert people.first().name == "N" and held.first().session_id == "s" and variants.count() == 0
    put(tmp_path / "r.json", {"people": [{"id": "p", "canonical": "Bo", "role": "x"}], "aliases": [{"token": "Beau", "person_id": "p"}]})
    a, b = ja.read_roster(spark, str(tmp_path / "r.json"))
    assert a.first().canonical == "Bo" and b.first().token == "Beau"
    put(tmp_path / "l.json", {"entries": [{"canonical": "Arjuna", "category": "hero", "variants": ["Urjun"], "aliases": ["Partha"]}]})
    assert ja.read_library(spark, str(tmp_path / "l.json")).first().variants == ["Urjun"]


def test_section_overwrite(spark, tmp_path):
    path, schema = str(tmp_path / "flags"), "detector_id string, session_id string, n int"
    def write(flags, done):
        tables.overwrite_sections(spark, spark.createDataFrame(flags, schema), spark.createDataFrame(done, "detector_id string, session_id string"), path)
    a, b = "20240101-1", "20240102-1"
    write([("m9a", a, 1), ("m9b", a, 2), ("m9a", b, 3)], [("m9a", a), ("m9b", a), ("m9a", b)])
    write([("m9a", a, 9)], [("m9a", a), ("m9a", b)])
    assert sorted(r.n for r in tables.read_session(spark, path, a).collect()) == [2, 9]
    assert tables.read_session(spark, path, b).count() == 0
    assert sorted(tuple(r) for r in tables.section_stamps(spark, path).collect()) == [("m9a", a), ("m9a", b), ("m9b", a)]
    assert sorted(r.n for r in tables.read_sections(spark, path).collect()) == [2, 9]


def test_raw_rows_are_appended(spark, tmp_path):
    path = str(tmp_path / "raw")
    for n in (1, 2):
        tables.append_raw(spark.createDataFrame([("20240101-1", n)], "session_id string, n int"), path)
    assert sorted(r.n for r in tables.read_session(spark, path, "20240101-1").collect()) == [1, 2]


def test_intake_stream(spark, tmp_path):
    inbox, known, cp = tmp_path / "inbox", str(tmp_path / "recordings"), str(tmp_path / "cp")
    seen = []
    def run(rows, name):
        inbox.mkdir(exist_ok=True)
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("uuid", "session_id", "md5", "path", "ordinal"), r))) for r in rows))
        q = intake(spark, str(inbox), known, cp, lambda df, _: seen.extend(sorted(r.path for r in df.collect())))
        q.awaitTermination()
    run([("u1", "t1", "h1", "a", 0), ("u1", "t2", "h2", "b", 1), (None, "t1", "h9", "c", 2)], "1.json")
    run([(None, "t1", "h1", "d", 0), ("u5", "t5", "h5", "e", 1)], "2.json")
    verdicts = {r.path: r.verdict for r in spark.read.parquet(known).collect()}
    assert verdicts == {"a": "new", "b": "duplicate", "c": "collision", "d": "duplicate", "e": "new"}
    assert seen == ["a", "e"]


def test_refused_arrivals_are_no_recordings(spark):
    schema = "uuid string, session_id string, md5 string, ordinal long"
    rows = [("u1", "t1", "h1", 0), ("u2", "t1", "h2", 1), ("u2", "t9", "h9", 2), (None, "t1", "h2", 3), (None, "t1", "h1", 4), ("u2", "t5", "h5", 5), (None, "t9", "h9", 6)]
    got = inc.classify_intake(spark.createDataFrame(rows, schema), spark.createDataFrame([], "uuid string, session_id string, md5 string"))
    assert [r.verdict for r in got.orderBy("ordinal").collect()] == ["new", "collision", "new", "collision", "duplicate", "duplicate", "duplicate"]


def test_status(spark):
    meta = spark.createDataFrame([("s", "old", None)], "session_id string, note string, validation_status string")
    ch = spark.createDataFrame([("s", None, "done"), ("t", "hi", None)], meta.schema)
    assert {tuple(r) for r in inc.set_status(meta, ch).collect()} == {("s", "old", "done"), ("t", "hi", "not_started")}
