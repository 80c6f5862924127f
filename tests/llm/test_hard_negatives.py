"""Hard-negative mining against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from parley.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, every=100, positives=5, negatives=10):
    clean = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        clean.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for i, (a, la, xa) in enumerate(clean):
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(xa, x)), v, lab == la) for j, (v, lab, x) in enumerate(clean) if j != i]
        for ps, p, _ in sorted(s for s in scored if s[2])[:positives]:
            near = sorted((ns, v) for ns, v, same in scored if not same and -30 * ps <= -100 * ns <= -90 * ps)[:negatives]
            out += [(a, p, k, v, -ps, -ns) for k, (ns, v) in enumerate(near, 1)]
    return sorted(out)


def clustered(seed, n, dims=64, labels=10):
    """Vectors around one centre per label, all centres sharing a direction, some exactly equal."""
    rng = np.random.default_rng(seed)
    common, centres = rng.normal(size=dims), rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        x = common * 1.5 + centres[label] + rng.normal(size=dims) * 0.7
        rows.append((i, [float(np.float32(c)) for c in x / np.linalg.norm(x)], label))
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(20)]
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("cells, block", [(1 << 20, 2048), (1, 3)])
def test_mining_equals_plain_python(spark, cells, block):
    rows = clustered(1, 700)
    random.Random(2).shuffle(rows)
    got = rows_of(hn.mine(spark.createDataFrame(rows, SCHEMA), every=20, cells=cells, block=block))
    assert got == by_hand(rows, every=20) and len(got) > 500


def test_other_widths_and_lengths(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(0, 1) for _ in range(rng.choice([5, 7, 40]))], i % 3) for i in range(200)]
    assert rows_of(hn.mine(spark.createDataFrame(rows, SCHEMA), every=10)) == by_hand(rows, every=10)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 2), (100, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, [0.25, 0.5], 2),
            (4, None, 1), (5, [1.0, None], 2), (6, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
            (200, [0.0, 0.0], 3), (201, [], 3), (300, [-1.0, 0.0], 1), (14, [0.5, 0.4], 9), (-100, [0.3, 0.3], 2), (3, [0.25, 0.5], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("rid", "v", "slice", "block", "anchor", "positive", "n", "width", "positives")})
    assert rows_of(hn.mine(df)) == by_hand(rows) != []


def test_nothing_to_mine(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 2)], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(4, None, 1)], SCHEMA)).count() == 0


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(PythonException, match="64 bits"):
        hn.mine(spark.createDataFrame([(100, [1e30], 1), (1, [1.0], 1)], SCHEMA)).collect()


def test_one_label_may_hold_nearly_all_rows(spark):
    rows = [(i, x, 0 if i % 9 else lab) for i, x, lab in clustered(3, 600)]
    assert rows_of(hn.mine(spark.createDataFrame(rows, SCHEMA), every=50, cells=1, block=2)) == by_hand(rows, every=50)


def test_bounds_hold_and_tighten(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-200, 200, (60, 64))
    scores, widths = x @ x.T, []
    for s in hn.levels(64):
        mean, dev = hn.summary(x, s)
        mid, off = mean @ mean.T, dev @ dev.T + hn.slack(x, x)
        assert (mid - off <= scores).all() and (scores <= mid + off).all()
        widths.append(off.mean())
    assert widths == sorted(widths, reverse=True) and hn.levels(64) == [4, 8, 16, 32]


def test_bounds_rule_out_rows_of_smooth_vectors():
    """Vectors whose segments are nearly constant leave few rows for exact scores."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.integers(-100, 100, (2_000, 4)), 16, axis=1) + rng.integers(-2, 3, (2_000, 64))
    ids = np.arange(len(x))
    near = hn.Slice(ids, ids, np.zeros(len(x)), x)
    for a, rows, scores in near.bounds(x[:10], lambda _, low, high: high >= hn.kth(low, 5), np.ones((10, len(x)), bool)):
        exact = x @ x[a]
        assert sorted(scores[hn.best(scores, rows, 5)]) == sorted(exact[hn.best(exact, ids, 5)])
    assert near.scored < 0.05 * 10 * len(x)


def test_matrix_pads_with_zeros():
    got = hn.matrix(pa.chunked_array([pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float64()))]), 4)
    assert got.tolist() == [[1, 2, 0, 0], [0, 0, 0, 0], [3, 0, 0, 0]]
