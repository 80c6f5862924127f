"""The review list: whole cards, lower-case uses, and phrases that take over their words."""

from parley.operators import names as nm

WORDS = "session_id string, seg_pos int, word_index int, word string"


def test_phrases_take_over_the_detectors_of_their_words(spark):
    lines = ["I saw Rubber Ducky here", "and Rubber Ducky there", "a ducky of Mohan", "then mohan left Zed", "we met Ducky's friend"]
    w = spark.createDataFrame([("s", i, k, t) for i, x in enumerate(lines) for k, t in enumerate(x.split())], WORDS)
    family = spark.createDataFrame([("s", 1, 2, "ducky")], "session_id string, seg_pos int, word_index int, c string")
    odd = spark.createDataFrame([("s", 2, 3, "mohan")], "session_id string, seg_pos int, word_index int, c string")
    coded = spark.createDataFrame([("s", 3)], "session_id string, seg_pos int")
    got = {(r.seg_pos, r.word_index, r.c): (",".join(r.detectors), r.cap, r.watch, r.is_phrase, r.coded) for r in nm.review_list(w, family, odd, ["session_id"], coded=coded).collect()}
    assert got == {
        (0, 2, "rubber ducky"): ("m9a", True, False, True, False), (1, 1, "rubber ducky"): ("m9a", True, False, True, False),
        (2, 1, "ducky"): ("m9a", False, False, False, False), (4, 2, "ducky"): ("m9a", True, False, False, False),
        (2, 3, "mohan"): ("m9b", True, False, False, False), (3, 1, "mohan"): ("m9b", False, False, False, True)}


def test_watched_forms_and_lines(spark):
    w = spark.createDataFrame([("s", 0, k, t) for k, t in enumerate(" quiet words and more words".split(" ")) if t], WORDS)
    none = spark.createDataFrame([], "session_id string, seg_pos int, word_index int, c string")
    watch = spark.createDataFrame([("s", "words"), ("s", "absent")], "session_id string, c string")
    got = nm.review_list(w, none, none, ["session_id"], watch).collect()
    assert sorted((r.word_index, r.c, r.watch, r.line) for r in got) == [(2, "words", True, "quiet words and more words"), (5, "words", True, "quiet words and more words")]
