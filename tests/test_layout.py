"""Bucketed artifact tables: same rows, no shuffle for joins by segment, pruned reads of one recording."""

from pathlib import Path
from urllib.parse import urlparse
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from parley.sources import layout as la

IDS = ["20240101-000001", "20240101-000002", "20240102-000001"]


@pytest.fixture
def layout(spark, tmp_path):
    made = la.Layout("t" + uuid4().hex, str(tmp_path / "artifacts"), buckets=4)
    words = [(s, i, j, f"w{i}{j}") for s in IDS for i in range(6) for j in range(i)]
    la.save(spark.createDataFrame(words, "session_id string, seg_pos int, word_index int, word string"), made, "words")
    la.save(spark.createDataFrame([(s, i, f"text {i}") for s in IDS for i in range(6)], "session_id string, seg_pos int, text string"), made, "segments")
    for kind in ("turns", "vectors", "identifications", "notes", "labels", "pending"):
        la.save(spark.createDataFrame([(s, f"{kind} {n}") for s in IDS for n in range(3)], "session_id string, what string"), made, kind)
    yield made
    for kind in la.ARTIFACTS:
        spark.sql(f"DROP TABLE IF EXISTS {made.name(kind)}")


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_words_meet_their_segments_where_they_lie(spark, layout):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = la.segment_words(spark, layout)
        grouped = met.groupBy("session_id", "seg_pos", "text").agg(F.count(F.lit(1)).alias("n"))
        assert "Exchange" not in plan(met) and "Exchange" not in plan(grouped)
        got = {(r.session_id, r.seg_pos): (r.text, r.n) for r in grouped.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {(s, i): (f"text {i}", i) for s in IDS for i in range(1, 6)}


def test_a_long_recording_fills_several_buckets(spark, layout):
    files = la.of_recording(spark, layout, "words", IDS[0]).select(F.input_file_name()).distinct().count()
    assert files > 1


def spoil_others(layout, kind, kept):
    """Make every file of a table unreadable but the one with a recording's rows."""
    files = list(Path(layout.path, kind).rglob("*.parquet"))
    for f in files:
        if str(f) != kept:
            f.write_bytes(b"unreadable")
    return len(files)


def test_one_recording_reads_one_bucket_of_one_day(spark, layout):
    for kind in [k for k, keys in la.ARTIFACTS.items() if keys == la.RECORDING]:
        one = la.of_recording(spark, layout, kind, IDS[1])
        (where,) = one.select(F.input_file_name().alias("f")).distinct().collect()
        assert spoil_others(layout, kind, urlparse(where["f"]).path) == 3
        assert sorted(r.what for r in one.collect()) == [f"{kind} {n}" for n in range(3)]
        assert "PartitionFilters: [isnotnull(day" in plan(one) and "Exchange" not in plan(one)
        assert la.of_recording(spark, layout, kind, "20991231-000000").count() == 0


def test_words_of_one_recording_read_its_day_only(spark, layout):
    one = la.of_recording(spark, layout, "words", IDS[2])
    assert one.count() == 15 and "PartitionFilters: [isnotnull(day" in plan(one)
    assert one.select(F.input_file_name().alias("f")).filter(~F.col("f").contains("day=20240102")).count() == 0


def test_rows_added_later_lie_with_the_earlier_ones(spark, layout):
    la.save(spark.createDataFrame([(IDS[0], "late")], "session_id string, what string"), layout, "notes")
    one = la.of_recording(spark, layout, "notes", IDS[0])
    assert one.count() == 4 and one.select(F.input_file_name().substr(-24, 9)).distinct().count() == 1


def test_an_unknown_artifact_is_refused(spark, layout):
    with pytest.raises(ValueError):
        la.artifact(spark, layout, "songs")
