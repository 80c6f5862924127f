"""Spellings taken from the benchmark: the query against its SQL where a text's last words are said."""

import duckdb
import pytest

from parley.plans import catalog

catalog.load()


@pytest.mark.parametrize("text", ["one two three four", "zero one two three four", "three four", "four"])
def test_the_last_run_of_a_text_counts(spark, tmp_path, text):
    sf = str(tmp_path)
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(sf + "/benchmark.parquet")
    rows = [(5, 0, "user", "so one two three four it is"), (5, 1, "assistant", "four")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(sf + "/conversations.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet/*.parquet')")
    df = catalog.QUERIES["find_spellings"](spark, sf)
    ours = sorted(tuple(r) for r in df.collect())
    theirs = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL['find_spellings']})").fetchall())
    assert ours == theirs and ("5", 0, 4, "four") in ours
    assert (("5", 0, 1, "one two three four") in ours) == (len(text.split()) >= 4)
