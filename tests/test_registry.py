"""Detector registry: what runs, what is replaced, what a crash leaves behind."""

import pytest
from pyspark.sql import functions as F

from parley.operators import registry as rg

WORDS = "session_id string, seg_pos int, word_index int, word string"


def words(spark, texts):
    return spark.createDataFrame([(s, 0, i, w) for s, t in texts.items() for i, w in enumerate(t.split())], WORDS)


class Spy:
    """A detector that flags words of a length and remembers the recordings it was given."""

    def __init__(self, name, length, **more):
        self.calls = []
        self.judges = []
        self.detector = rg.Detector(name, f"label of {name}", "M1", "1", self.run, config=f"length={length}", **more)
        self.length = length

    def run(self, w, judge):
        self.calls.append(sorted(r[0] for r in w.select("session_id").distinct().collect()))
        self.judges.append(judge is not None)
        return w.filter(F.length("word") == self.length).select(
            "session_id", "seg_pos", "word_index", F.lit("long").alias("kind"), F.col("word").alias("detail"))


def found(spark, path):
    return sorted((r.session_id, r.detector_id, r.detail) for r in rg.flags(spark, path).collect())


def sections(spark, path):
    return {(r.session_id, r.detector_id): (r.run_no, r.n_flags, r.n_word_tokens) for r in rg.ledger(spark, path).collect()}


def test_a_second_scan_plans_no_detector_and_a_change_reruns_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "sections")
    three, four = Spy("three", 3), Spy("four", 4)
    texts = {"a": "one four", "b": "none at all", "c": "at"}
    assert rg.scan(words(spark, texts), path, [three.detector, four.detector]) == ["three", "four"]
    assert found(spark, path) == [("a", "four", "four"), ("a", "three", "one"), ("b", "four", "none"), ("b", "three", "all")]
    assert sections(spark, path)["c", "three"] == (1, 0, 1)

    assert rg.scan(words(spark, texts), path, [three.detector, four.detector]) == []
    assert len(three.calls) == len(four.calls) == 1

    two = Spy("three", 2)
    assert rg.scan(words(spark, texts), path, [two.detector, four.detector]) == ["three"]
    assert two.calls == [["a", "b", "c"]] and len(four.calls) == 1
    assert found(spark, path) == [("a", "four", "four"), ("b", "four", "none"), ("b", "three", "at"), ("c", "three", "at")]

    assert rg.scan(words(spark, texts | {"b": "gone"}), path, [two.detector, four.detector]) == ["three", "four"]
    assert two.calls[-1] == four.calls[-1] == ["b"]
    assert found(spark, path) == [("a", "four", "four"), ("b", "four", "gone"), ("c", "three", "at")]
    assert sections(spark, path)["b", "three"] == (3, 0, 1) and sections(spark, path)["a", "four"][0] == 1


def test_force_other_detectors_and_other_recordings(spark, tmp_path):
    path = str(tmp_path / "sections")
    three, four = Spy("three", 3), Spy("four", 4)
    rg.scan(words(spark, {"a": "one four", "b": "two"}), path, [three.detector, four.detector])
    assert rg.scan(words(spark, {"a": "one four"}), path, [three.detector], force=True) == ["three"]
    assert three.calls[-1] == ["a"] and len(four.calls) == 1
    assert {k: v[0] for k, v in sections(spark, path).items()} == {("a", "three"): 2, ("a", "four"): 1, ("b", "three"): 1, ("b", "four"): 1}


def test_offline_detectors_and_judges(spark, tmp_path):
    path = str(tmp_path / "sections")
    slow, judged, plain = Spy("slow", 3, offline_only=True), Spy("judged", 3, accepts_judge=True), Spy("plain", 3)
    every, w, judge = [slow.detector, judged.detector, plain.detector], words(spark, {"a": "one"}), spark.range(1)
    assert rg.scan(w, path, every, judge=judge) == ["judged", "plain"]
    assert judged.judges == [True] and plain.judges == [False] and slow.calls == []
    assert {r.detector_id: r.judge_applied for r in rg.ledger(spark, path).collect()} == {"judged": True, "plain": False}
    assert rg.scan(w, path, every, run_offline=True) == ["slow"]


@pytest.mark.parametrize("dies_in", ["commit", "second detector"])
def test_a_crash_leaves_the_sections_as_they_were(spark, tmp_path, monkeypatch, dies_in):
    path = str(tmp_path / "sections")
    one, two = Spy("one", 3), Spy("two", 4)
    rg.scan(words(spark, {"a": "old four"}), path, [one.detector, two.detector])
    before = found(spark, path)
    edited = words(spark, {"a": "new five six"})

    def die(*_):
        raise RuntimeError("killed")

    broken = rg.Detector("two", "label", "M1", "1", die, config="length=4")
    with monkeypatch.context() as m:
        if dies_in == "commit":
            m.setattr(rg, "_commit", die)
        with pytest.raises(RuntimeError, match="killed"):
            rg.scan(edited, path, [one.detector, two.detector if dies_in == "commit" else broken])
    assert found(spark, path) == before
    assert rg.scan(edited, path, [one.detector, two.detector]) == ["one", "two"]
    assert found(spark, path) == [("a", "one", "new"), ("a", "one", "six"), ("a", "two", "five")]


def test_a_configless_detector_and_staleness(spark, tmp_path):
    path = str(tmp_path / "sections")
    bare = rg.Detector("bare", "label", "M2", "1", lambda w, _: w.select("session_id", "seg_pos", "word_index", F.lit("x").alias("kind"), F.lit(None).alias("detail")))
    w = words(spark, {"a": "one two", "b": "three"})
    assert rg.scan(w, path, [bare]) == ["bare"] and rg.scan(w, path, [bare]) == []
    now = words(spark, {"a": "one two changed"})
    assert {(r.session_id, r.stale) for r in rg.is_stale(now, path).collect()} == {("a", True), ("b", True)}
    assert {(r.session_id, r.stale) for r in rg.is_stale(w, path).collect()} == {("a", False), ("b", False)}
