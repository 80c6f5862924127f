"""Chat records above the sizes that Spark parses as one variant or one string."""

import json

from pyspark.sql import functions as F

from parley.llm import chat


def test_outlines_have_the_paths_of_their_records(spark):
    hard = 'a "q": [{}, {"x": 1}] \\ } ] : , \n'
    cases = [{"messages": [{"role": "user", "content": hard}, {"role": "assistant", "content": None}] * 3}, {"a{}, {}": hard, "b\": ": [{"c": hard}, {}, {}, {"d": [hard]}]},
             [], [hard, {"x": [hard]}], hard, {"": ""}, {"n": [{"x": 1}, {"x": 2}, {"y": [[{"z": hard}]]}], "t": True}]
    texts = [t for c in cases for t in (json.dumps(c), json.dumps(c, indent=2), json.dumps(c, separators=(",", ":"), ensure_ascii=False))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, '{"a": "b', "{broken", '{"a": 1,, "b": ""}', None])], "i int, record string")
    record = F.col("record")
    for r in df.select("record", chat.field_paths(record).alias("want"), chat.field_paths(chat.outline(record)).alias("got")).collect():
        assert r.got == r.want, r.record


def test_many_messages_make_a_small_outline(spark):
    one = spark.range(1).select(F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.struct(
        F.lit("user").alias("role"), i.cast("string").alias("content"))).alias("messages"))).alias("record"))
    assert one.select(chat.outline(F.col("record"))).first()[0] == '{"messages":[{"role":"","content":""}]}'


def test_conversations_above_the_variant_limit_keep_all_turns(spark):
    """Conversation 1 has 140 MB, conversation 2 one text of more than 20 million characters."""
    sizes = [(1, t, 20_000_000) for t in range(7)] + [(2, 0, 20_000_001), (2, 1, 3), (3, 0, 5)]
    rows = spark.createDataFrame(sizes, "conv_id long, turn long, n int").select("conv_id", "turn", F.lit("assistant").alias("role"), F.repeat(F.lit("a"), F.col("n")).alias("text"))
    made = chat.format_chats(chat.rows_to_records(rows))
    got = made.select("conv_id", "layout", F.transform("turns", lambda t: F.length(t["text"])).alias("n"), F.transform("loss_spans", lambda s: s["length"]).alias("loss")).collect()
    assert {r.conv_id: r.layout for r in got} == dict.fromkeys((1, 2, 3), "messages")
    assert {r.conv_id: r.n for r in got} == {r.conv_id: r.loss for r in got} == {c: [n for k, _, n in sizes if k == c] for c in (1, 2, 3)}
