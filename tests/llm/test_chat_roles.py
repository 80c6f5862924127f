"""Roles of any characters are read back as they were."""

import random

from pyspark.sql import functions as F

from parley.llm import chat


def test_any_role_comes_back(spark):
    rng = random.Random(1)
    signs = ["\\", "\n", "n", "\x00", "a", "<", "</s>", "[INST]", "é", "\U0001f600", "\\n", "\x00\\"]
    roles = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    roles += [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    roles += ["a\x00b", "\\", "\\\\", "\\n", "\\\n", "\n\\", "\\\\n", "\x00"]
    df = spark.createDataFrame(list(enumerate(roles)), "i long, role string")
    back = df.select("i", chat._role_in(chat._role_out(F.col("role"))).alias("back"), chat._role_out(F.col("role")).alias("out")).collect()
    assert [r.back for r in sorted(back)] == roles
    assert all("\n" not in r.out for r in back)


def test_a_conversation_with_odd_roles(spark):
    roles = ["a\x00b", "user\\n", "as\nsistant", "assistant"]
    rows = spark.createDataFrame([(1, k, r, f"text {k}") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.rows_to_records(rows)).select(chat.parse(F.col("formatted")).alias("b")).first().b
    assert [(t.role, t.text) for t in made] == [(r, f"text {k}") for k, r in enumerate(roles)]
