"""Quality classifier: parts against plain Python, the whole by held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import quality_classifier as qc

from .conftest import LONG

SF = "/root/testdata/sf0.01"


def test_statistics_by_hand():
    text = "The CAT sat.\nthe cat!! sat\n\nthe cat!! sat\n 1 #é"
    got = dict(zip(qc.STATISTICS, qc.statistics(pa.array([text, None, "", " \n\t", "The CAT"]))[0]))
    words = text.split()
    triples = list(zip(words, words[1:], words[2:]))
    size = len(text.encode())
    want = {"log_words": np.log1p(len(words)), "word_bytes": sum(len(w.encode()) for w in words) / len(words),
            "distinct": len(set(words)) / len(words), "repeated": 1 - len(set(triples)) / len(triples), "log_lines": np.log1p(4),
            "duplicate_lines": 0.25, "shouted": 4 / 27, "bang": np.sqrt(4 / size), "symbol": np.sqrt(1 / size), "digit": np.sqrt(1 / size),
            "beyond": np.sqrt(2 / size), "upper": np.sqrt(4 / size), "newline": np.sqrt(4 / size), "stop": np.sqrt(1 / size)}
    assert {k: got[k] for k in want} == pytest.approx(want)
    rest = qc.statistics(pa.array([None, "", " \n\t"]))
    assert np.isfinite(rest).all() and (rest[0] == rest[1]).all()


def test_statistics_do_not_depend_on_neighbours_or_slices():
    texts = pa.array(["a b c", None, LONG, "a b c", "é", "", LONG + " x"])
    whole = qc.statistics(texts)
    alone = np.vstack([qc.statistics(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.array_equal(whole, alone) and np.array_equal(whole[0], whole[3])


def test_normal_equations_are_exact_whole_numbers_in_any_split(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, len(qc.STATISTICS))), rng.integers(0, 2, 300)
    mean, scale = x.mean(0), x.std(0)
    rows = [([float(c) for c in r], float(k)) for r, k in zip(x, y)]
    sums = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "x array<double>, y double").repartition(parts)
        got = df.mapInArrow(qc._normal_equations(mean, scale), "i int, j int, s long").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        sums.append({(r.i, r.j): r.s for r in got})
    z = np.column_stack([qc.lift(x, mean, scale), y * 2**qc.FIXED]).astype(object)
    gram = z.T @ z
    assert sums[0] == sums[1] == {(i, j): gram[i, j] for i in range(len(gram)) for j in range(i, len(gram))}


def test_ridge_solves_its_equations():
    rng = np.random.default_rng(2)
    z, y = np.column_stack([rng.normal(size=(500, 6)), np.ones(500)]), rng.integers(0, 2, 500)
    a = np.column_stack([z, y])
    w = qc.solve(a.T @ a, 500, ridge=0.1)
    gradient = z.T @ (z @ w - y) / 500 + np.append(np.full(6, 0.1), 1e-9) * w
    assert np.abs(gradient).max() < 1e-9


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, len(qc.STATISTICS)))
    z = qc.lift(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1] / 2.0**qc.FIXED
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * qc.WIDTH**2))
    assert np.abs(2 * z @ z.T / qc.FEATURES - kernel).mean() < 0.08


def isotonic_by_hand(n, hits):
    """min over j of max over i of the mean over [i, j], the textbook form."""
    k = len(n)
    return [min(max(sum(hits[i:j + 1]) / sum(n[i:j + 1]) for i in range(at + 1)) for j in range(at, k)) for at in range(k)]


def test_isotonic_equals_the_min_max_form():
    rng = random.Random(4)
    for _ in range(30):
        n = [rng.randint(1, 9) for _ in range(12)]
        hits = [rng.randint(0, k) for k in n]
        x, share = qc.isotonic(np.arange(12.0), np.array(n, float), np.array(hits, float))
        assert list(share) == sorted(share)
        pooled, at = [], 0
        for value in share:
            size = isotonic_by_hand(n, hits).count(value) or sum(1 for v in isotonic_by_hand(n, hits) if abs(v - value) < 1e-12)
            pooled += [value] * size
            at += size
        assert pooled == pytest.approx(isotonic_by_hand(n, hits)) and at == 12


def test_held_out_accuracy_and_whole_result(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = qc.classify(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    seen = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(seen) > 50 and sum(a == b for a, b in seen) / len(seen) >= 0.95


def test_held_out_labels_change_no_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    masked = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    one, two = (sorted(tuple(r) for r in qc.classify(d, k).collect()) for d, k in ((docs, labels), (masked.repartition(5), turned)))
    assert one == two


def test_awkward_rows(spark, clashing, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (2, 1), (7, 1), (8, None), (99, 1), (None, 0), (9, 0)], "doc_id long, quality int")
    got = sorted((tuple(r) for r in qc.classify(clashing, labels).collect()), key=repr)
    assert len(got) == clashing.count() and got == sorted((tuple(r) for r in qc.classify(awkward, labels).collect()), key=repr)
    assert all(0 <= r[2] <= 1 for r in got)
    none = qc.classify(awkward, labels.filter("false")).collect()
    assert len(none) == len(got) and {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    one_class = qc.classify(awkward, labels.filter("doc_id in (1, 7)")).collect()
    assert len(one_class) == len(got)
    assert qc.classify(empty, labels).count() == 0
