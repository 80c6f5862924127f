"""Spellings are found in a segment's own row: spellings that begin alike cost nothing, and no word is numbered or moved."""

import random

import duckdb
import pytest

from parley.operators import skew
from parley.plans import catalog

catalog.load()


def both(spark, sf, lines, texts):
    """The query's rows and those of its SQL."""
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(sf + "/benchmark.parquet")
    spark.createDataFrame(lines, "conv_id long, turn int, role string, text string").write.parquet(sf + "/conversations.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet/*.parquet')")
    df = catalog.QUERIES["find_spellings"](spark, sf)
    theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL['find_spellings']})").fetchall()
    return df, sorted(tuple(r) for r in df.collect()), sorted(theirs)


@pytest.mark.parametrize("sent", [0, 16 << 20])
def test_odd_lines_equal_sql(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(skew, "SENT", sent)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "an", "cat", "dog's", "12", "Ünder"]) for _ in range(k)) for k in range(9)] + [None, "", " the  cat\n", "an cat the the"]
    lines = [(k, j, "user", " ".join(rng.choice(["The", "an", "cat,", "dogs", "--", "Ünder"]) for _ in range(rng.randrange(12)))) for k in range(12) for j in range(3)]
    lines += [(89, 0, "user", "-- An cat, the the cat"), (90, 0, "user", "the cat"), (90, 0, "user", "the cat"), (90, 1, "user", None), (90, 2, "user", " "), (90, 2, "user", "the an cat"),
              (None, 1, "user", "the cat"), (91, None, "user", "the cat")]
    _, ours, theirs = both(spark, str(tmp_path), lines, texts)
    assert ours == theirs and any(len(r[3].split()) == 4 for r in ours)


def test_spellings_that_begin_alike_make_no_rows(spark, tmp_path):
    """Each of 300 spellings begins with the word that all of 400 words are."""
    texts = [f"the {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abc'[i // 100]} zz yy" for i in range(300)]
    df, ours, theirs = both(spark, str(tmp_path), [(1, t, "user", "the " * 100) for t in range(4)], texts)
    assert ours == theirs and len(ours) == 400
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan and "[cleaned" in plan.split("Join")[1]


def test_nothing_to_find(spark, tmp_path):
    _, ours, theirs = both(spark, str(tmp_path), [(1, 0, "user", "the cat")], ["12", ""])
    assert ours == theirs == []
