"""Phrases of one word are counted as the words pass by: no place of theirs is written, however often they stand."""

import pytest

from parley.operators import corrections as co
from parley.operators import phrases as ph
from parley.operators import skew


@pytest.mark.parametrize("limit", [0, 16 << 20])
@pytest.mark.parametrize("written", [None, "own"])
def test_places_of_single_words_are_not_written(spark, monkeypatch, limit, written):
    monkeypatch.setattr(skew, "SENT", limit)
    rows, plain = [], ph.staged

    def spied(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ph, "staged", spied)
    t = spark.createDataFrame([(i, "Pan pans, " * 200 + "end") for i in range(30)] + [(99, None)], "id long, text string")
    p = spark.createDataFrame([("pan", False), ("pa", True), ("pans, end", False)], "v string, open boolean")
    got = ph.phrases_in(t, ["id"], "text", p, "v", "open", written).collect()
    assert {(r.v, r._n) for r in got} == {("pan", 200), ("pa", 400), ("pans, end", 1)} and len(got) == 90
    assert written is None or {(r.v, r.own) for r in got} == {("pan", "Pan"), ("pa", "Pan"), ("pans, end", "pans, end")}
    assert max(rows) <= 90


def test_texts_under_one_id_add_up(spark):
    t = spark.createDataFrame([(1, "pan pan"), (1, "pan"), (2, "pots")], "id long, text string")
    names = spark.createDataFrame([("N", "pan", False), ("N", "pot", True), ("M", "pot", False)], "canonical string, variant string, prefix boolean")
    assert [tuple(r) for r in co.occurrences_by_pattern(t, ["id"], names).collect()] == [("N", 4, 2, 2)]


def test_distinct_words_are_asked_and_not_each_use(spark):
    t = spark.createDataFrame([(i, "pan pans " * 50) for i in range(9)], "id long, text string")
    wanted = spark.createDataFrame([("pan", False), ("pa", True), ("x", True)], "_w string, _goes_on boolean")
    got = ph.uses(ph.word_rows(t, ["id"], "text"), wanted)
    assert sorted(tuple(r) for r in got.collect()) == [("pa", True, 900), ("pan", False, 450)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")
