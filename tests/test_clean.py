"""Cleaned tokens against the rule in plain Python."""

import re

from parley.functions.text import clean


def by_hand(token):
    t = re.sub(r"[^a-z'’]+$", "", token.strip().lower())
    t = re.sub(r"^[^a-z'’]+", "", t)
    return re.sub(r"[^a-z]", "", re.sub(r"['’]s?$", "", t))


def test_letters_alone_and_all_other_tokens_follow_one_rule(spark):
    tokens = ["House", "house", "HOUSES", "s", "", " ", "Marta's", "marta’s", "d'Or", "“Où", "été", "a\n", "abc\n", " abc", "a1b", "'s", "s's", "x-y", "...", " Pandav,", "İx"]
    rows = spark.createDataFrame([(t,) for t in tokens] + [(None,)], "t string").select("t", clean("t").alias("c")).collect()
    assert [(r.t, r.c) for r in rows if r.c != (None if r.t is None else by_hand(r.t))] == []
