"""Source divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import divergence as dv

from .conftest import table


def share(n, total, v):
    return 1 + 10**9 * (n + 5) // (total + 5 * v)


def by_hand(rows, min_docs, top):
    """rows: (doc_id, text, lang, source)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        v, whole = len(kept), Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(share(count[lang, s][t], n[s], v) - share(count[lang, o][t], n[o], v)) for t in kept), o.encode(), o)
                     for o in sources if o != s]
            out |= {(lang, s, "pair", o, -d, k) for k, (d, _, o) in enumerate(sorted(pairs), 1)}
            over = [(share(whole[t], sum(whole.values()), v) - share(count[lang, s][t], n[s], v), t.encode(), t) for t in kept if count[lang, s][t]]
            ranked = sorted(x for x in over if x[0] < 0)[:top]
            out |= {(lang, s, "term", t, -d, k) for k, (d, _, t) in enumerate(ranked, 1)}
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [f"{a}{b}" for a in "abcdéß漢" for b in ("", "x", "Y", "zz")]
    rows = []
    for i in range(n):
        source = rng.choice(["s1", "s2", "s3", "ü", None, "only"])
        text = rng.choice([" ", "-", "1", "\n"]).join(rng.choice(pool[: rng.choice([6, 28])]) for _ in range(rng.randrange(30)))
        rows.append((i, rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None]), source))
    return [*rows, (n, "", "xx", "a"), (n, None, "xx", "b"), (n, "1 2 3", "xx", "b")]


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


@pytest.mark.parametrize("segment, bucket", [(8192, 16), (4, 2)])
def test_audit_equals_plain_python(spark, segment, bucket):
    rows = corpus(3, 150)
    got = rows_of(dv.audit(table(spark, rows), min_docs=8, top=4, segment=segment, bucket=bucket))
    assert got == by_hand(rows, 8, 4)


def test_small_parts_and_long_texts_change_nothing(spark, monkeypatch):
    rows = [*corpus(4, 60), (900, "longword" * 40 + " a b" * 500, "en", "s1")]
    want = by_hand(rows, 3, 50)
    for name, value in (("PIECE", 64), ("HELD", 20)):
        monkeypatch.setattr(dv, name, value)
    pieces = [t for p in dv._pieces(("ab" * 100 + " C1d " + "é" * 90).encode()) for t in p]
    assert pieces == [b"ab" * 100, b"c", b"d", ("é" * 90).encode()]
    assert rows_of(dv.audit(table(spark, rows), min_docs=3)) == want


def test_awkward_rows_clashing_names_and_empty_tables(spark, clashing, empty):
    from .conftest import AWKWARD
    assert rows_of(dv.audit(clashing, min_docs=2)) == by_hand([(*r, None, None)[:4] for r in AWKWARD], 2, 50)
    assert dv.audit(empty).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    rows = [(1, "twice twice seen", "en", "a")] * 2 + [(2, "seen", "en", "b")]
    got = rows_of(dv.audit(table(spark, rows), min_docs=2))
    assert got == by_hand(rows, 2, 50) and any(r[2] == "term" for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), unique=True), st.lists(st.integers(0, 400), unique=True))
def test_gallop_finds_the_common_values(a, b):
    a, b = sorted((np.array(sorted(x), np.int32) for x in (a, b)), key=len)
    i, j = dv.gallop(a, b)
    assert list(a[i]) == list(b[j]) == sorted(set(a) & set(b))


def test_gallop_over_arrays_of_very_different_length():
    long = np.arange(0, 300_000, 3, dtype=np.int32)
    short = np.unique(np.random.default_rng(1).integers(0, 300_000, 200)).astype(np.int32)
    i, j = dv.gallop(short, long)
    assert list(short[i]) == list(long[j]) == [x for x in short if x % 3 == 0]


def test_shares_are_exact_far_beyond_64_bit_products(spark):
    n, total, v = 5 * 10**14 + 7, 8 * 10**15 + 11, 10**9
    assert int(dv._share(np.array([n]), total, v)[0]) == share(n, total, v)
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert df.select(dv.share("n", "total", "v")).first()[0] == share(n, total, v)


def test_a_hot_source_is_counted_whole(spark):
    rows = [(i, f"w{'abcdefghij'[i % 10]} same", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    assert rows_of(dv.audit(table(spark, rows).repartition(13))) == by_hand(rows, 30, 50)
