"""Decisions on waiting corrections: one commit over words, queue, dictionary and audit."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley.operators import corrections as co
from parley.operators import decisions as dc

WORDS = "session_id string, seg_pos int, word_index int, word string"
ASKED = "ordinal long, session_id string, key string, action string, canonical string"
SPOTS = "session_id string, key string, seg_pos int, word_index int"
WAIT = "session_id string, key string, world string, heard string, canonical string, state string, seg_pos int, word_index int"
TEXT = {"a": [" Bheem, came home", " and bheem left"], "b": [" Bheem stays", " Gandari! too"]}


def store(spark, path, parts=3):
    words = [(s, i, j, " " + w) for s, lines in TEXT.items() for i, l in enumerate(lines) for j, w in enumerate(l.split())]
    waiting = [("a", "bheem", "epic", "Bheem", "Bhima", "pending", 0, 0), ("a", "bheem", "epic", "Bheem", "Bhima", "pending", 1, 1),
               ("b", "bheem", "epic", "Bheem", "Bhima", "auto", 0, 0), ("b", "gandari", None, "Gandari", "Gandhari", "pending", 1, 0)]
    held = spark.createDataFrame([("epic", "bhima", "Beema")], "world string, canonical string, variant string")
    dc.create(spark.createDataFrame(words, WORDS), spark.createDataFrame(waiting, WAIT), held, path, parts)


def ask(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ASKED)


def view(spark, path, version=None):
    words = {(r.session_id, r.seg_pos, r.word_index): (r.word, r.original, [(c.stage, c["from"], c.to) for c in r.corrections])
             for r in dc.state(spark, path, "words", version).collect() if r.corrections}
    queue = sorted((r.session_id, r.key, r.canonical, r.state, r.seg_pos, r.word_index) for r in dc.state(spark, path, "waiting", version).collect())
    names = sorted((r.world, r.canonical, r.variant, r.since) for r in dc.state(spark, path, "dictionary", version).collect())
    audit = sorted((r.version, r.kind, r.session_id, r.key, r.canonical, r.n_places or 0, r.provenance or "") for r in dc.state(spark, path, "audit", version).collect())
    return words, queue, names, audit


def outcome(df):
    return [(r.status, r.n_places) for r in df.orderBy("ordinal").collect()]


def test_a_whole_blessing_changes_words_queue_dictionary_and_audit(spark, tmp_path):
    path = str(tmp_path / "s")
    store(spark, path)
    assert outcome(dc.decide(spark, path, ask(spark, ("a", "bheem", "bless", None)))) == [("blessed", 2)]
    words, queue, names, audit = view(spark, path)
    assert words == {("a", 0, 0): (" Bhima,", "Bheem,", [("namefix_bless", "Bheem", "Bhima")]), ("a", 1, 1): (" Bhima", "bheem", [("namefix_bless", "bheem", "Bhima")])}
    assert [q[:2] for q in queue] == [("b", "bheem"), ("b", "gandari")]
    assert names == [("epic", "bhima", "Beema", 0), ("epic", "bhima", "Bheem", 1)]
    assert audit == [(1, "blessed", "a", "bheem", "Bhima", 2, ""), (1, "variant", "a", "bheem", "Bhima", 0, "bless:a")]
    assert view(spark, path, 0)[0] == {} and len(view(spark, path, 0)[1]) == 4 and view(spark, path, 0)[3] == []
    assert sorted(map(tuple, dc.touched_segments(spark, path, 1).collect())) == [("a", 0), ("a", 1)]
    assert dc.state(spark, path, "words").count() == dc.state(spark, path, "words", 0).count() == 10


def test_chosen_places_leave_the_rest_waiting_and_the_dictionary_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    store(spark, path)
    one = spark.createDataFrame([("a", "bheem", 1, 1)], SPOTS)
    assert outcome(dc.decide(spark, path, ask(spark, ("a", "bheem", "bless", " Arjuna ")), one)) == [("partly blessed", 1)]
    words, queue, names, audit = view(spark, path)
    assert list(words) == [("a", 1, 1)] and words["a", 1, 1][0] == " Arjuna"
    assert ("a", "bheem", "Arjuna", "pending", 0, 0) in queue and len(names) == 1
    assert audit == [(1, "blessed", "a", "bheem", "Arjuna", 1, "")]
    nowhere = spark.createDataFrame([("a", "bheem", 7, 7)], SPOTS)
    assert outcome(dc.decide(spark, path, ask(spark, ("a", "bheem", "bless", None)), nowhere)) == [("no matching place", 0)]
    assert dc.head(spark, path)["version"] == 1
    assert outcome(dc.decide(spark, path, ask(spark, ("a", "bheem", "bless", None)))) == [("blessed", 1)]
    assert view(spark, path)[0]["a", 0, 0][0] == " Arjuna,"


def test_rejecting_demoting_and_decisions_that_find_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    store(spark, path)
    got = dc.decide(spark, path, ask(spark, ("b", "gandari", "reject", None), ("b", "bheem", "demote", None), ("b", "gandari", "bless", None),
                                     ("a", "gone", "bless", None), ("a", "bheem", "demote", None), ("b", "bheem", "burn", None), (None, None, "bless", None)))
    assert outcome(got) == [("rejected", 1), ("demoted", 1), ("deferred", 0), ("no such group", 0), ("no such group", 0), ("unknown action", 0), ("no such group", 0)]
    words, queue, names, audit = view(spark, path)
    assert words == {} and len(names) == 1
    assert {q[:2]: q[3] for q in queue} == {("a", "bheem"): "pending", ("b", "bheem"): "pending", ("b", "gandari"): "rejected"}
    assert [a[1] for a in audit] == ["demoted", "rejected"]
    # without a world the dictionary learns nothing, and a blessed word in another case is not added twice
    assert outcome(dc.decide(spark, path, ask(spark, ("b", "bheem", "bless", "BHIMA"), ("a", "bheem", "bless", None)))) == [("blessed", 1), ("blessed", 2)]
    assert view(spark, path)[2] == [("epic", "bhima", "Beema", 0), ("epic", "bhima", "Bheem", 2)]
    assert sum(a[1] == "variant" for a in view(spark, path)[3]) == 2


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store(spark, path)
    before = view(spark, path)
    real, publish = dc._write, dc._publish
    for failing in ("words", "waiting", "dictionary", "publish"):
        def broken(df, where, name, run, spread=()):
            real(df, where, name, run, spread)
            if name == failing:
                raise OSError("lost")

        def unpublished(*args):
            if failing == "publish":
                raise OSError("lost")
            publish(*args)
        monkeypatch.setattr(dc, "_write", broken)
        monkeypatch.setattr(dc, "_publish", unpublished)
        with pytest.raises(OSError):
            dc.decide(spark, path, ask(spark, ("a", "bheem", "bless", None)))
        monkeypatch.undo()
        assert dc.head(spark, path)["version"] == 0
    assert view(spark, path) == before
    assert outcome(dc.decide(spark, path, ask(spark, ("a", "bheem", "bless", None)))) == [("blessed", 2)]
    assert len(view(spark, path)[0]) == 2 and dc.head(spark, path)["version"] == 1


def test_a_second_writer_of_one_version_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store(spark, path)
    first = dc.head(spark, path)
    dc.decide(spark, path, ask(spark, ("b", "gandari", "reject", None)))
    after = view(spark, path)
    monkeypatch.setattr(dc, "head", lambda *_: first)
    with pytest.raises(dc.Conflict):
        dc.decide(spark, path, ask(spark, ("a", "bheem", "bless", None)))
    monkeypatch.undo()
    assert view(spark, path) == after


def test_a_text_is_healed_from_the_touched_segments(spark, tmp_path):
    path = str(tmp_path / "s")
    store(spark, path)
    dc.decide(spark, path, ask(spark, ("b", "gandari", "bless", None)))
    lines = spark.createDataFrame([("b", 0, "old"), ("b", 1, "old")], "session_id string, seg_pos int, text string")
    words = dc.state(spark, path, "words").join(dc.touched_segments(spark, path, 1), ["session_id", "seg_pos"], "left_semi")
    assert sorted(map(tuple, co.heal_text(lines, words).select("session_id", "seg_pos", "text").collect())) == [("b", 0, "old"), ("b", 1, " Gandhari! too")]


def test_random_batches_equal_plain_python(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "s")
    forms = ["anu", "bela", "chan", "devi"]
    words = {(f"s{s}", i, j): rng.choice(forms) for s in range(5) for i in range(6) for j in range(5)}
    queue = {(s, c, i, j): ("pending" if rng.random() < .7 else "auto", c.upper(), f"w{hash_of(s)}") for (s, i, j), c in words.items() if rng.random() < .8}
    dictionary = {("w0", "ANU", "old")}
    dc.create(spark.createDataFrame([(*k, v) for k, v in words.items()], WORDS),
              spark.createDataFrame([(s, c, w, c, n, st, i, j) for (s, c, i, j), (st, n, w) in queue.items()], WAIT),
              spark.createDataFrame(sorted(dictionary), "world string, canonical string, variant string"), path, 4)
    for batch in range(2):
        asked = [(f"s{rng.randrange(6)}", rng.choice(forms), rng.choice(["bless", "bless", "reject", "demote"]), rng.choice([None, "", f"N{batch}"])) for _ in range(12)]
        spots = {(s, c, i, j) for (s, c, i, j) in list(queue) if rng.random() < .15 and s in ("s1", "s2")}
        seen, expected = set(), []
        snapshot = dict(queue)
        members = defaultdict(list)
        for (s, c, i, j), v in snapshot.items():
            members[s, c, v[0]].append((s, c, i, j))
        for s, c, action, own in asked:
            if (s, c) in seen:
                expected.append(("deferred", 0))
                continue
            seen.add((s, c))
            mine = members[s, c, "auto" if action == "demote" else "pending"]
            chosen = [m for m in mine if m in spots] if action == "bless" and any(x[:2] == (s, c) for x in spots) else mine
            if not mine:
                expected.append(("no such group", 0))
            elif not chosen:
                expected.append(("no matching place", 0))
            else:
                expected.append(({"bless": "blessed" if len(chosen) == len(mine) else "partly blessed", "reject": "rejected", "demote": "demoted"}[action], len(chosen)))
                name, world = own or snapshot[mine[0]][1], snapshot[mine[0]][2]
                for m in mine:
                    if m in chosen and action == "bless":
                        words[m[0], m[2], m[3]] = name
                        del queue[m]
                    else:
                        queue[m] = ({"bless": "pending", "reject": "rejected", "demote": "pending"}[action], name if action == "bless" else snapshot[m][1], world)
                if action == "bless" and chosen == mine and c.lower() != name.lower():
                    dictionary.add((world, name, c))
        got = dc.decide(spark, path, ask(spark, *asked), spark.createDataFrame(sorted(spots), SPOTS))
        assert outcome(got) == expected
        assert {(r.session_id, r.seg_pos, r.word_index): r.word for r in dc.state(spark, path, "words").collect()} == words
        assert {(r.session_id, r.key, r.seg_pos, r.word_index): (r.state, r.canonical, r.world) for r in dc.state(spark, path, "waiting").collect()} == queue
        assert {(r.world, r.canonical, r.variant) for r in dc.state(spark, path, "dictionary").collect()} == dictionary


def hash_of(session):
    return int(session[1:]) % 2
