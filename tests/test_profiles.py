"""Nearest profiles with pruning against all pairs."""

import numpy as np

from parley.operators import identity as idn

K = ["session_id", "speaker_key"]


def clustered(rng, n, centres, noise):
    return [centres[rng.integers(len(centres))] + rng.normal(size=centres.shape[1]) * noise for _ in range(n)]


def tables(spark, speakers, profiles):
    s = spark.createDataFrame([(str(i // 5), str(i % 5), [float(x) for x in v]) for i, v in enumerate(speakers)], "session_id string, speaker_key string, vector array<double>")
    p = spark.createDataFrame([(f"p{i}", i, None if v is None else [float(x) for x in v]) for i, v in enumerate(profiles)],
                              "profile_id string, rank int, centroid array<double>")
    return s, p


def by_hand(speakers, profiles):
    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n else v
    out = {}
    for i, v in enumerate(speakers):
        scored = [(round(float(unit(v) @ unit(c)), 9), -k) for k, c in enumerate(profiles) if c is not None]
        s, k = max(scored)
        out[str(i // 5), str(i % 5)] = (f"p{-k}", s)
    return out


def found(df):
    return {(r.session_id, r.speaker_key): (r.profile_id, round(r.similarity, 9)) for r in df.collect()}


def test_pruned_search_equals_all_pairs_and_scores_less_than_half(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    profiles, speakers = clustered(rng, 300, centres, 0.15), clustered(rng, 60, centres, 0.15)
    got = idn.nearest_profiles(*tables(spark, speakers, profiles), K, pivots=24, size=8)
    assert found(got) == by_hand(speakers, profiles)
    assert sum(r.n_scored for r in got.collect()) < 0.5 * 300 * 60


def test_vectors_without_structure_zero_and_missing_centroids_and_ties(spark):
    rng = np.random.default_rng(2)
    profiles = [*rng.normal(size=(30, 8)), np.zeros(8), None]
    profiles += [profiles[3] * 2.0, profiles[4]]
    speakers = [*rng.normal(size=(20, 8)), np.zeros(8), profiles[3], -profiles[5]]
    got = found(idn.nearest_profiles(*tables(spark, speakers, profiles), K, size=4))
    want = by_hand(speakers, profiles)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert got["4", "0"][0] == "p0" and got["4", "1"][1] == 1.0


def test_no_profiles_and_only_zero_profiles(spark):
    s, p = tables(spark, [np.ones(3)], [None, np.zeros(3)])
    assert found(idn.best_profiles(s, p, K)) == {("0", "0"): ("p1", 0.0)}
    assert idn.best_profiles(s, p.filter("centroid is null"), K).count() == 0
