"""Runs of a segment are found in its row: the same as plain Python finds, and no word is moved or sorted."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from parley.operators.runs import runs_in_segment
from parley.plans import bindings as b
from parley.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"


def test_runs_equal_plain_python(spark):
    rng = random.Random(3)
    rows = [(k, [(i, rng.choice("ab-"), rng.randrange(9), rng.randrange(9)) for i in range(k % 9)]) for k in range(200)] + [(200, None)]
    lines = spark.createDataFrame(rows, 'k int, words array<struct<word_index: int, word: string, start: int, end: int>>')
    for least in (1, 2, 3):
        want = []
        for k, words in rows:
            for letter, run in groupby(words or [], lambda w: w[1]):
                run = list(run)
                if letter != "-" and len(run) >= least:
                    want.append((k, len(run), run[0][0], min(w[2] for w in run), run[-1][3], letter))
        runs = runs_in_segment(F.col("words"), lambda w: F.when(w["word"] != "-", w["word"]), least)
        assert sorted(tuple(r) for r in lines.select("k", F.inline(runs)).collect()) == sorted(want)


def test_words_as_array_are_the_rows(spark):
    flat = b.lines_of_words(spark, SF).select("session_id", "seg_pos", F.inline("words"))
    rows = b.words(spark, SF)
    assert flat.columns == rows.columns and flat.count() == rows.count()
    assert flat.exceptAll(rows).count() == 0


def test_no_word_is_moved(spark):
    for name in ("census_table", "garbage_census", "repeat_runs"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Window" in x and "word_index" in x]
