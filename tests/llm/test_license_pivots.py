"""Pruning of licence passages loses no match."""

import random

import regex
from parley.llm import licenses

from .conftest import table


def test_every_match_has_a_pivot_word():
    rng = random.Random(1)
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            grams = licenses._plain_bigrams(text)
            for floor in (0.5, 0.8, 0.95):
                pattern = regex.compile(licenses.pivot_pattern(licenses.pivot_words(grams, floor)))
                for _ in range(50):
                    c = rng.randrange(len(grams) + 1)
                    if 2 * c >= floor * (c + len(grams)) and c:
                        kept = rng.sample(grams, c)
                        assert pattern.search(" ... ".join(kept))


def test_a_floor_of_zero_prunes_nothing():
    assert licenses.pivot_words(["a b", "b c"], 0.0) == []


def test_pruned_scan_equals_the_unpruned_one(spark, monkeypatch):
    rng = random.Random(2)
    wordings = [t for ts in licenses.TEMPLATES.values() for t in ts]

    def edited():
        w = rng.choice(wordings).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["zz", "_the_", "LICENSE", "é"])
        return " ".join(w)

    rows = [(i, rng.choice(["\n", "\n\n", " "]).join(rng.choice([edited(), "plain words of no licence", ""]) for _ in range(3))) for i in range(80)]
    docs = table(spark, [*rows, (900, None), (901, "")])
    pruned = sorted(map(tuple, licenses.scan_licenses(docs).collect()))
    monkeypatch.setattr(licenses, "pivot_words", lambda *_: [])
    assert pruned == sorted(map(tuple, licenses.scan_licenses(docs).collect())) != []
