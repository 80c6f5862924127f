"""Queries over timed words against their SQL, on rows that the given small tables hold seldom."""

from datetime import datetime, timedelta

import duckdb
import pytest

from parley.plans import catalog

catalog.load()


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Two recordings, one with empty words (value 0)."""
    at = datetime(2024, 1, 1)
    made = [(0, 7, "view", 100.0), (30, 7, "click", 0.0), (300, 7, "error", 400.0), (360, 7, "view", 2.0), (540, 7, "view", 0.0), (560, 8, "view", 1.0)]
    rows = [(i, at + timedelta(minutes=m), u, t, v, f'{{"k": {i}}}') for i, (m, u, t, v) in enumerate(made)]
    sf = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(sf + "/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet/*.parquet')")
    return sf, con


@pytest.mark.parametrize("name", ["timestamp_drift", "drift_tally"])
def test_empty_words_are_covered_by_nobody(spark, events, name):
    sf, con = events
    df = catalog.QUERIES[name](spark, sf)
    ours = sorted(tuple(r) for r in df.collect())
    assert ours and ours == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall())
