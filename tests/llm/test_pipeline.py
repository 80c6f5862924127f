"""Every stage of the pipeline against plain Python or SQL on its own input."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from parley.llm import sql
from parley.session import staged

from .conftest import table
from .test_brute import by_library, classes_by_hand, near_rows, words


@pytest.fixture(scope="module")
def stages(spark):
    """(input rows, output rows) of each stage, run one after the other."""
    rng = random.Random(11)
    texts = [t for _, t in near_rows()]
    rows = [(i, t, "en", f"s{i % 5}") for i, t in enumerate(texts + rng.choices(texts, k=40) + ["12 34", "!!", None, ""])]
    docs, out = staged(table(spark, rows)), {}
    for name, run in corpus_pipeline.STAGES:
        made = staged(run(spark, docs, ""))
        out[name] = (docs.collect(), made.collect())
        docs = made
    return out


def test_language_stage_drops_texts_without_letters_only(stages):
    given, kept = stages["language_id"]
    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in given if r.text and any(c.isalpha() for c in r.text))


def test_exact_stage_keeps_the_largest_id_of_each_text(stages):
    given, kept = stages["exact_dedup"]
    last = {}
    for r in given:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert {(r.doc_id, r.text) for r in kept} == {(d, t) for t, d in last.items()} and len(kept) == len(last)


def test_near_stage_keeps_the_least_of_each_class(stages):
    given, kept = stages["minhash_near_dedup"]
    classes = classes_by_hand([(r.doc_id, r.text) for r in given])
    assert sorted(r.doc_id for r in kept) == sorted({root for _, root in classes.values()})
    assert len(kept) < len(given)


def test_mixing_stage_takes_what_the_sql_takes(stages):
    given, kept = stages["mixing"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in given])
    want = dict(con.execute(f"SELECT doc_id, taken FROM ({sql.MIXING}) WHERE taken > 0").fetchall())
    got = Counter()
    for r in kept:
        got[r.doc_id] += len(words(r.text))
    assert dict(got) == want


def test_packing_stage_holds_every_id_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    given, pieces = stages["packing"]
    want = Counter(i for r in given for i in [*by_library(tokenizer, r.text), 2])
    assert Counter(i for p in pieces for i in np.frombuffer(bytes(p.ids), "<u4").tolist()) == want
    filled = defaultdict(int)
    for p in pieces:
        filled[p.sequence_id] += len(p.ids) // 4
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())
