"""Steps that several name queries share: done once, and on no more rows than needed."""

import pytest

from parley.operators import names as nm
from parley.plans import bindings as b
from parley.plans import catalog
from parley.plans import q_names as qn

catalog.load()
SF = "/root/testdata/sf0.001"


def test_words_are_cleaned_after_they_are_counted(spark):
    plan = qn.frequent_words(b.table(spark, SF, "documents"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
    assert "regexp_replace" not in plan[plan.rindex("Aggregate"):].split("\n", 1)[1]


def test_frequent_words(spark):
    docs = spark.createDataFrame([("Dogs " * 12 + "... " * 40,), ("dogs, " * 8 + "cat " * 19,), (None,)], "text string")
    assert [r.word for r in qn.frequent_words(docs).collect()] == ["dogs"]


@pytest.mark.parametrize("name", ["combined_catches", "gated_and_shielded"])
def test_the_word_list_is_made_once(spark, monkeypatch, name):
    made, plain = [], qn.common_words
    monkeypatch.setattr(qn, "common_words", lambda *a: made.append(1) or plain(*a))
    catalog.QUERIES[name](spark, SF)
    assert len(made) == 1


def test_neighbours_are_found_once(spark):
    w = spark.createDataFrame([("a", 0, 0, "Ann."), ("a", 0, 1, "Lee"), ("a", 1, 0, "Bob")], "session_id string, seg_pos int, word_index int, word string")
    full = nm.beside(w)
    assert "Window" not in nm.bigrams(full.checkpoint())._jdf.queryExecution().optimizedPlan().toString()
    cols = ["session_id", "seg_pos", "word_index", "word", "c", "cap", "initial", "c2", "word2"]
    assert sorted(tuple(r) for r in full.select(cols).collect()) == [
        ("a", 0, 0, "Ann.", "ann", True, True, "lee", "Lee"), ("a", 0, 1, "Lee", "lee", True, True, None, None), ("a", 1, 0, "Bob", "bob", True, True, None, None)]
    assert nm.bigrams(full).select(cols).collect() == nm.bigrams(w).join(nm.sentence_initial(w), ["session_id", "seg_pos", "word_index", "word"]).select(cols).collect()


def test_examples_move_texts_once_per_line(spark):
    occ = spark.createDataFrame([("a", "k", 0), ("a", "k", 1), ("a", "k", 2), ("a", "k", 3), ("a", "k", 5), ("a", "m", 2)], "session_id string, card_key string, seg_pos int")
    lines = spark.createDataFrame([("a", 0, " x y"), ("a", 1, "z"), ("a", 2, "x y "), ("a", 3, " "), ("a", 4, "u"), ("a", 5, "u"), ("b", 0, "x y")], "session_id string, seg_pos int, text string")
    out = nm.card_examples(occ, lines, ["session_id"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", "k", "u", 5, 3), ("a", "k", "x y", 0, 1), ("a", "k", "z", 1, 2), ("a", "m", "x y", 2, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("card_key" in x.split("],")[0] and "line" in x.split("],")[0] for x in plan.splitlines() if "Aggregate [" in x)
