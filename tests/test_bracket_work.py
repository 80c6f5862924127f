"""Nearest rows on both sides: work in step with the rows of a block, one row out per probe."""

from pyspark.sql import functions as F

from parley.operators.asof import bracket
from parley.operators.scans import NextSeen, block_of, scan


def test_next_seen_goes_over_a_block_once(spark):
    """Frames that end with the partition are computed anew for each row: 40,000 rows were 800 million steps."""
    rows = spark.range(40000).select(F.lit("a").alias("k"), "id", F.when(F.col("id") % 1000 == 7, F.col("id")).alias("x"))
    for inclusive in (False, True):
        out = scan(rows, ["k"], ["id"], block_of("id", 10 ** 6), n=NextSeen(F.col("x"), inclusive))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedfollowing" not in plan.lower()
        got = {r.id: r.n for r in out.collect()}
        for i in (0, 6, 7, 8, 1006, 1007, 39006, 39007, 39008, 39999):
            at = i if inclusive else i + 1
            assert got[i] == next((x for x in range(at, 40000) if x % 1000 == 7), None)


def test_next_seen_passes_blocks_without_a_value(spark):
    rows = spark.createDataFrame([("a", t, t if t in (5, 31) else None) for t in range(0, 40)] + [("b", 3, None)], "k string, t int, x int")
    got = {(r.k, r.t): r.n for r in scan(rows, ["k"], ["t"], block_of("t", 4), n=NextSeen(F.col("x"))).collect()}
    assert got == {**{("a", t): 5 if t < 5 else 31 if t < 31 else None for t in range(40)}, ("b", 3): None}


def test_equal_probes_and_missing_points(spark):
    probe = spark.createDataFrame([("a", 5, 9), ("a", 5, 9), ("a", 5, 9), ("a", None, 9), ("a", 5, None), ("b", 1, 2)], "k string, start int, end int")
    build = spark.createDataFrame([("a", 4, 1), ("a", 4, 0), ("a", 5, 2), ("a", 9, 4), ("a", 9, 3), ("c", 1, 5)], "k string, start int, id int")
    got = [tuple(r) for r in bracket(probe, build, ["k"], ["id"], "id", 3).collect()]
    assert sorted(got, key=str) == sorted([("a", 5, 9, 0, 3)] * 3 + [("a", None, 9, None, 3), ("a", 5, None, 0, None), ("b", 1, 2, None, None)], key=str)
