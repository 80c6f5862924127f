"""The four orders of the session list, as a reader sees them."""

import pytest

from parley.operators import evaluate as ev
from parley.operators import incremental as inc

ROWS = [("20240103-000000", 30.0, "done", 2), ("20240101-000000", None, "not_started", 5), ("20240102-000000", 30.0, "in_progress", 2),
        ("20240104-000000", 10.0, "not_started", 0), ("20240105-000000", None, "done", 5)]
STATES = ["not_started", "in_progress"]
KEYS = {"date": lambda r: r[0], "length": lambda r: -1.0 if r[1] is None else r[1],
        "validation": lambda r: STATES.index(r[2]) if r[2] in STATES else 2, "notes": lambda r: r[3]}


@pytest.mark.parametrize("by", list(KEYS))
@pytest.mark.parametrize("descending", [True, False])
def test_orders(spark, by, descending):
    df = spark.createDataFrame(ROWS, "session_id string, duration_seconds double, validation_status string, note_count int").repartition(3)
    newest_first = sorted(ROWS, key=lambda r: r[0], reverse=True)
    want = sorted(newest_first, key=KEYS[by], reverse=descending)
    assert [r.session_id for r in inc.sort_sessions(df, by, descending).collect()] == [r[0] for r in want]


def test_net_forcing(spark):
    rates = spark.createDataFrame([("cast", 8, 3, 0.375), ("none", 8, 1, 0.125)], "mode string, n_clips long, n_forced long, rate double")
    assert tuple(ev.net_forcing(rates, "cast", "none").first()) == (8, 8, 3, 1, 2, 0.25)
    assert tuple(ev.net_forcing(rates.limit(0), "cast", "none").first()) == (0, 0, 0, 0, 0, 0.0)
