"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from parley.llm import exact_dedup, language_id, licenses, mixing, near_dedup, packing, quality, substring_dedup, token_counts
from parley.llm.chat import format_chats, rows_to_records
from parley.llm.queries import QUERIES, SQL

from .conftest import AWKWARD, LONG

PER_DOCUMENT = {
    "quality": lambda d: quality.decide(quality.ledger(d)),
    "mixing": mixing.mix,
    "near_dedup": near_dedup.near_duplicates,
    "language_id": language_id.identify,
    "exact_dedup": exact_dedup.exact_copies,
    "substring_dedup": substring_dedup.remove_repeats,
}
OTHER = {"token_counts": token_counts.token_counts, "licenses": licenses.scan_licenses, "packing": packing.pack}


def seen(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_per_document(name, awkward):
    got = PER_DOCUMENT[name](awkward).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in AWKWARD)


@pytest.mark.parametrize("name", [*PER_DOCUMENT, *OTHER])
def test_other_columns_change_nothing(name, awkward, clashing):
    op = {**PER_DOCUMENT, **OTHER}[name]
    assert seen(op(clashing)) == seen(op(awkward))


@pytest.mark.parametrize("name", [*PER_DOCUMENT, *OTHER])
def test_an_empty_table_gives_no_rows(name, empty):
    assert {**PER_DOCUMENT, **OTHER}[name](empty).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage, awkward, clashing, empty):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, empty, "").count() == 0
    got = run(spark, clashing, "")
    if stage != "packing":
        assert got.columns == clashing.columns
        assert {r.text for r in got.collect() if r.text} <= {r[1] for r in AWKWARD} or stage == "mixing"
        assert run(spark, awkward, "").count() == got.count() > 0


def test_language_stage_rejects_texts_without_letters(spark, awkward):
    kept = {r.text for r in corpus_pipeline.identify_language(spark, awkward, "").collect()}
    assert kept == {r[1] for r in AWKWARD if r[1] and any(c.isalpha() for c in r[1])}


def test_near_stage_keeps_the_least_and_one_text(spark, awkward):
    got = corpus_pipeline.drop_near_copies(spark, awkward, "").collect()
    assert [r.doc_id for r in got if r.text and r.text.startswith(LONG)] == [7]
    assert [r.doc_id for r in got if r.text and r.text.startswith("the cat")] == [1]


def test_chat_rows_with_nulls(spark):
    schema = "conv_id long, turn long, role string, text string, record string"
    rows = [(None, None, None, None, "x"), (1, 1, "user", "a", "x"), (1, 0, None, None, "x"), (1, 1, "user", "a", "x")]
    got = {r.conv_id: r for r in format_chats(rows_to_records(spark.createDataFrame(rows, schema))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", "a"), ("user", "a")] and len(got[None].turns) == 1
    assert format_chats(rows_to_records(spark.createDataFrame([], schema))).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name, monkeypatch):
    import check
    from parley.plans import catalog

    monkeypatch.setitem(catalog.QUERIES, name, QUERIES[name])
    if name in SQL:
        monkeypatch.setitem(catalog.SQL, name, SQL[name])
    verdict, _ = check.compare(spark, check.connect(SF), name, SF)
    assert not verdict.startswith("FAIL"), verdict


def test_the_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.filter("offset + length > 4096").count() == 0
