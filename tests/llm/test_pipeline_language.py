"""The pipeline's language stage lets the prediction decide."""

import random

import corpus_pipeline

from .conftest import table

ENGLISH = "the and with this which would there their about other people water house through little thing where always".split()
GERMAN = "der und nicht auch eine wird durch über schon haben werden zwischen immer wieder können möchte straße welche".split()


def test_only_documents_predicted_as_english_go_on(spark):
    rng = random.Random(9)
    made = [("en", ENGLISH), ("de", GERMAN)] * 150
    rows = [(i, " ".join(rng.choices(words, k=40)), lang, "s") for i, (lang, words) in enumerate(made)]
    odd = [(1000, " ".join(rng.choices(GERMAN, k=40)), None, "s"), (1001, " ".join(rng.choices(ENGLISH, k=40)), None, "s"), (1002, "12 34", "en", "s")]
    kept = corpus_pipeline.identify_language(spark, table(spark, rows + odd), "").collect()
    assert sorted(r.doc_id for r in kept) == [*range(0, 300, 2), 1001]
