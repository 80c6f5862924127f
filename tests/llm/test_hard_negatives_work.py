"""Hard negatives: what the bounds and scores cost, in the products they make, and scores at the edge of floating point."""

import numpy as np
import pytest

from parley.llm import hard_negatives as hn
from tests.llm.test_hard_negatives import SCHEMA, by_hand, clustered, rows_of


def near(x):
    return hn.Slice(np.arange(len(x)), np.arange(len(x)), np.zeros(len(x)), x)


def levels_asked(x, anchors, k=5):
    """(rows left, times ``keep`` was called for an anchor) where the k best are wanted."""
    calls, rows = [], near(x)

    def keep(a, low, high):
        calls.append(a)
        return high >= hn.kth(low, k)

    for a, found, scores in rows.bounds(x[:anchors], keep, np.ones((anchors, len(x)), bool)):
        whole = x @ x[a]
        assert sorted(scores[hn.best(scores, found, k)]) == sorted(whole[hn.best(whole, np.arange(len(x)), k)])
    return rows.scored, len(calls) / anchors


def test_levels_that_rule_out_nothing_are_not_asked_further():
    """Vectors without structure: a finer level would cost as much as the scores that it can't save."""
    x = np.random.default_rng(1).integers(-100, 101, (2_000, 64))
    assert levels_asked(x, 10) == (20_000, 1)


def test_levels_are_halved_where_that_pays():
    """Wide vectors with structure in short stretches only: the first level rules out little, the last nearly all."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.integers(-100, 101, (1_000, 32)), 32, axis=1) + rng.integers(-1, 2, (1_000, 1024))
    scored, asked = levels_asked(x, 10)
    assert asked == 4 and scored < 0.05 * 10 * len(x)


@pytest.mark.parametrize("large", [10**3, 10**7, 3 * 10**8])
def test_scores_are_exact_at_any_size(large):
    rng = np.random.default_rng(3)
    x = rng.integers(-large, large + 1, (50, 32))
    whole = [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in x] for a in x[:9]]
    assert near(x).scores(x[:9]).tolist() == whole


@pytest.mark.parametrize("sign", [1, -1])
def test_windows_that_end_first_hide_none(spark, sign):
    """Few rows, positives far apart and of either sign: windows that hold less than ten rows, or none."""
    rows = [(i, [sign * c for c in x[:6]] if i % 3 else x[:6], lab % 3) for i, x, lab in clustered(7, 160, dims=6)]
    assert rows_of(hn.mine(spark.createDataFrame(rows, SCHEMA), every=4)) == by_hand(rows, every=4) != []
