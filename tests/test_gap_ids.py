"""Gap ids have the digits that Python's and SQL's formats give."""

import random

from parley.functions.text import gap_id


def test_gap_ids_round_the_exact_value(spark):
    rng = random.Random(5)
    at = [375908.6985, 640142.2535, 0.0625, 0.1875, 1.0005, 2.0005, 0.9995, 0.9996, 7.9999999, 1e-7, 0.0, -1.0005, -0.3125, 3.0, 1e9 + 0.0005, 4503599627370.5]
    at += [rng.randrange(10 ** 10) / 1e4 for _ in range(2000)] + [rng.random() * 10 ** rng.randrange(8) for _ in range(500)] + [rng.randrange(10 ** 8) / 16 for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in at], "x double").select("x", gap_id("x").alias("id")).collect()
    assert [(r.x, r.id) for r in rows if r.id != f"gap_{r.x:.3f}"] == []
