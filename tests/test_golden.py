"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from parley.functions import phonetic as ph
from parley.functions import text as tx
from parley.functions import vectors as vec
from parley.operators import catches as ct
from parley.operators import corrections as co
from parley.operators import drift as dr
from parley.operators import evaluate as ev
from parley.operators import filters as fl
from parley.operators import gaps as gp
from parley.operators import identity as idn
from parley.operators import intervals as iv
from parley.operators import labels as lb
from parley.operators import names as nm
from parley.operators import runs, speakers, stories
from parley.operators.scans import block_of

S = ["session_id"]
WORD = "session_id string, seg_pos int, word_index int, word string, start double, end double, speaker_label string"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def turns(spark, *spans):
    return spark.createDataFrame([("s", float(a), float(b), c) for a, b, c in spans], "session_id string, start double, end double, speaker string")


def words(spark, *tokens, seg=0, session="s"):
    data = [(session, seg, i, t, float(i), i + 0.5, "A") for i, t in enumerate(tokens)]
    return spark.createDataFrame(data, WORD)


@pytest.mark.parametrize("span, talk, label, share", [
    ((2, 4), [(1, 5, "A")], "A", 1.0),
    ((2, 4), [(1, 3, "A")], "A", 0.5),
    ((5, 7), [(1, 3, "A"), (9, 11, "A")], None, 0.0),
    ((5, 5), [(1, 9, "A")], None, 0.0),
    ((3, 5), [(1, 4, "A"), (3.5, 7, "B")], "B", 0.75),
    ((2, 4), [(1, 3.5, "A"), (2.5, 5, "A")], "A", 1.0),
    ((2, 4), [(3, 5, "B"), (1, 3, "A")], "A", 0.5),
])
def test_word_speaker(spark, span, talk, label, share):
    w = spark.createDataFrame([("s", 0, float(span[0]), float(span[1]))], "session_id string, id int, start double, end double")
    r = speakers.word_speakers(w, turns(spark, *talk), S, ["id"], 10).first()
    assert (r.speaker_label, r.coverage) == (label, share)


def test_coverage_fractions(spark):
    w = spark.createDataFrame([("s", 0, 0.5, 1.5)], "session_id string, id int, start double, end double")
    r = speakers.coverage_fractions(w, turns(spark, (0, 1, "A"), (1, 2, "B")), S, ["id"], 5)
    assert rows(r, "speaker", "fraction", "total") == [("A", 0.5, 1.0), ("B", 0.5, 1.0)]


def gap_case(spark, speaker, before="A", after="A", word_end=0.0):
    segs = spark.createDataFrame([("s", 0, 0.0, 2.0, before), ("s", 1, 8.0, 9.0, after)], "session_id string, seg_pos int, start double, end double, speaker_label string")
    w = spark.createDataFrame([("s", 0.0, 2.0), ("s", 8.0, 9.0), ("s", 3.0, 3.0 + word_end)], "session_id string, start double, end double")
    return speakers.unintelligible_gaps(turns(spark, (3, 5, speaker)), w, segs, S, "seg_pos", 10, 100).select("seg_id", "start", "end", "speaker_label")


def test_unintelligible_gap(spark):
    assert rows(gap_case(spark, "B"), "*") == [("gap_3.000", 3.0, 5.0, "B")]
    assert gap_case(spark, "A").count() == 0
    assert gap_case(spark, "B", after="B").count() == 0
    assert gap_case(spark, "B", before=None).count() == 0
    assert gap_case(spark, "B", word_end=1.0).count() == 0
    assert gap_case(spark, "B", word_end=0.5).count() == 1


@pytest.mark.parametrize("spans, merged", [
    ([(0, 1), (0.5, 2)], [(0.0, 2.0)]), ([(0, 1), (1, 2)], [(0.0, 2.0)]), ([(1, 1), (2, 1), (0, .5)], [(0.0, 0.5)]),
])
def test_merge(spark, spans, merged):
    df = turns(spark, *[(a, b, "x") for a, b in spans])
    assert rows(iv.merge_intervals(df, S, 4), "start", "end") == merged


def test_subtract_and_gaps(spark):
    cut = iv.subtract(turns(spark, (0, 5, "A")), turns(spark, (1, 2, ""), (3, 3.5, "")), S, 2)
    assert rows(cut, "start", "end") == [(0.0, 1.0), (2.0, 3.0), (3.5, 5.0)]
    segs = turns(spark, (0, 1, ""), (1, 2, ""), (4, 5, ""))
    assert rows(gp.find_gaps(turns(spark, (0, 5, "A")), segs, S, 2, 0.3), "start", "end") == [(2.0, 4.0)]
    alone = gp.find_gaps(turns(spark, (0, 5, "A")), segs.filter("false"), S, 2, 0.3)
    assert rows(alone, "start", "end") == [(0.0, 5.0)]


def test_filters(spark):
    df = spark.createDataFrame([("a", None, 0.0, 0.01), ("b", None, None, None), ("c", "A", 0.0, 0.005)], "k string, speaker_label string, coverage double, probability double")
    r = {x.k: (x.s, x.z) for x in df.select("k", fl.silence_gap().alias("s"), fl.near_zero().alias("z")).collect()}
    assert r == {"a": (True, False), "b": (False, False), "c": (False, True)}


def test_duplicates_keep_the_first(spark):
    segs = spark.createDataFrame([("s", i, t) for i, t in enumerate(["hi", " ", "hi ", "", "Hi", "hi"])], "session_id string, seg_pos int, text string")
    assert rows(fl.duplicate_segments(segs, S, "seg_pos", block_of("seg_pos", 2)), "seg_pos") == [(2,), (5,)]
    assert rows(fl.duplicate_segments(segs, S, "seg_pos", block_of("seg_pos", 2), True), "seg_pos") == [(2,), (4,), (5,)]


def test_utterances(spark):
    data = [("s", 0, i, f" w{i}", float(i), i + 1.0, l) for i, l in enumerate(["A", "A", None, None, "B", "A"])]
    w = spark.createDataFrame(data, WORD)
    u = runs.utterances(w, S, ["seg_pos", "word_index"], block_of("word_index", 2))
    assert rows(u, "start", "end", "speaker_label", "text") == [
        (0.0, 2.0, "A", "w0 w1"), (2.0, 3.0, None, "w2"), (3.0, 4.0, None, "w3"), (4.0, 5.0, "B", "w4"), (5.0, 6.0, "A", "w5")]


def test_clean_transcript(spark):
    segs = spark.createDataFrame([("s", 0, "a", 0.0, 1.0), ("s", 1, "  ", 1.0, 2.0), ("s", 2, "b", 2.0, 2.0)], "session_id string, seg_pos int, text string, start double, end double")
    w = spark.createDataFrame([("s", 0, 0, 0.0, 0.0), ("s", 0, 1, 0.0, 1.0), ("s", 1, 0, 1.0, 2.0)], "session_id string, seg_pos int, word_index int, start double, end double")
    kept, inside = fl.clean_transcript(segs, w)
    assert rows(kept, "seg_pos") == [(0,)] and rows(inside, "word_index") == [(1,)]


@pytest.mark.parametrize("raw, bare, cap", [(" Marta's,", "marta", True), ("...", "", False), ('"Marta', "marta", True), ("marta’s", "marta", False), ("dogs'", "dogs", False)])
def test_clean(spark, raw, bare, cap):
    r = spark.createDataFrame([(raw,)], "w string").select(tx.clean("w").alias("c"), tx.is_capitalized("w").alias("cap")).first()
    assert (r.c, r.cap) == (bare, cap)


@pytest.mark.parametrize("word, codes", [
    ("martha", ["MR0", "MRT"]), ("marta", ["MRT"]), ("smith", ["SM0", "XMT"]), ("knight", ["NT"]), ("thomas", ["TMS"]), ("father", ["F0R", "FTR"]),
    ("vidura", ["FTR"]), ("laugh", ["LF"]), ("church", ["XRX", "XRK"]), ("michael", ["MKL", "MXL"]), ("caesar", ["SSR"]), ("bhishma", ["PXM"]), ("bushma", ["PXM"]),
    ("nation", ["NXN"]), ("jose", ["HS"]), ("dumb", ["TM"]), ("sugar", ["XKR", "SKR"]), ("school", ["SKL"]), ("zhao", ["J"]), ("filipowicz", ["FLPTS", "FLPFX"])])
def test_metaphone(word, codes):
    assert ph._sounds(word) == codes


def test_corrections(spark):
    fix = spark.createDataFrame([("fondos", "Pandavas", 0), ("gita", "Geeta", 0), ("gita", "Gita", 1), ("two words", "X", 2)], "transcribed string, correct string, ordinal int")
    once = co.apply_corrections(words(spark, " fondos", " Fondos's,", " gita’s", " two"), fix, "dictionary")
    got = {r.word_index: r for r in once.collect()}
    assert [got[i].word for i in range(4)] == [" Pandavas", " Pandavas's,", " Gita’s", " two"]
    assert got[0].original == "fondos" and len(got[0].corrections) == 1 and got[3].original is None
    again = co.apply_corrections(once, spark.createDataFrame([("pandavas", "Pandava", 0)], fix.schema), "llm")
    r = {x.word_index: x for x in again.collect()}[0]
    assert r.word == " Pandava" and r.original == "fondos" and [c.stage for c in r.corrections] == ["dictionary", "llm"]
    back = {x.word_index: x.word for x in co.revert_stage(again).collect()}
    assert back[0] == " fondos" and back[2] == " Gita’s"


def test_variants(spark):
    lib = spark.createDataFrame([(0, "Pandavas", ["Pandav", "pandavas"]), (1, "Bhagavad Gita", ["Bhagwad Gita"]), (2, "Pandu", ["Pandav"])], "entry_pos int, canonical string, variants array<string>")
    vm = co.variant_map(lib)
    assert rows(vm, "transcribed", "correct") == [("bhagwad gita", "Bhagavad Gita"), ("pandav", "Pandu")]
    texts = spark.createDataFrame([(0, "the Pandavas read the bhagwad Gita."), (1, "a Pandav!")], "id int, text string")
    assert rows(co.variant_scan(texts, ["id"], vm), "id", "transcribed", "correct") == [(0, "bhagwad Gita", "Bhagavad Gita"), (1, "Pandav", "Pandu")]
    odd = spark.createDataFrame([("lord of the ringz", "A"), ("hare krishna", "B"), ("o'brion", "C"), ("sita-ram", "D"), ("one two three four five six", "E")], "transcribed string, correct string")
    texts = spark.createDataFrame([(0, "The Lord of the Ringz, hare-krishna; O'Brion's"), (1, "Sita-Ram sita ram Hare Krishna"), (2, "One two three four five six!"), (3, "xo'brion, éhare krishna")], "id int, text string")
    assert rows(co.variant_scan(texts, ["id"], odd), "id", "transcribed", "correct") == [
        (0, "O'Brion", "C"), (0, "Lord of the Ringz", "A"), (1, "Hare Krishna", "B"), (1, "Sita-Ram", "D"), (2, "One two three four five six", "E")]
    names = spark.createDataFrame([("Arjuna", "arjuna", False), ("Pandavas", "pandava", True), ("Pandavas", "sons of pandu", False)], "canonical string, variant string, prefix boolean")
    texts = spark.createDataFrame([(0, "Arjuna's bow and the Pandavas, sons of Pandu; pandava"), (1, "arjunas")], "id int, text string")
    assert rows(co.occurrences_by_pattern(texts, ["id"], names), "canonical", "n", "n_variants", "n_texts") == [("Arjuna", 1, 1, 1), ("Pandavas", 3, 2, 1)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vec.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vec.cosine(F.col("a"), F.col("b"))).collect()


def test_identify(spark):
    people = spark.createDataFrame([("p", 0, [1.0, 0.0]), ("q", 1, None), ("r", 2, [1.0, 0.0])], "profile_id string, rank int, centroid array<double>")
    voices = spark.createDataFrame([("s", "1", [0.75, 0.6614378277661477]), ("s", "2", [0.45, 0.8930285549745877]), ("s", "3", [-1.0, 0.0])], "session_id string, speaker_key string, vector array<double>")
    r = {x.speaker_key: (x.status, x.profile_id, x.confidence) for x in idn.identify(voices, people).collect()}
    assert r["1"][:2] == ("identified", "p") and r["2"][:2] == ("suggested", "p") and r["3"] == ("unknown", None, None)
    cold = {x.status for x in idn.identify(voices, people.filter("centroid is null")).collect()}
    assert cold == {"unknown"}


def test_enrolment_and_variants(spark):
    schema = "profile_id string, session_id string, speaker_key string, vector array<double>"
    empty = spark.createDataFrame([], schema)
    first = idn.enrol(empty, spark.createDataFrame([("p", "s1", "0", [1.0, 3.0]), ("p", "s2", "0", [3.0, 5.0])], schema))
    twice = idn.enrol(first, spark.createDataFrame([("p", "s1", "9", [9.0, 9.0])], schema))
    assert twice.count() == 2
    assert idn.centroids(twice).first().centroid == [2.0, 4.0]


def test_story_tags(spark):
    segs = spark.createDataFrame([("s", i, x) for i, x in enumerate(["0", "1", "gap_2.5", "2", "3"])], "session_id string, seg_pos int, seg_id string")
    def tags(*st):
        df = spark.createDataFrame([("s", k, a, b) for k, (a, b) in enumerate(st)], "session_id string, story_idx int, start_id string, end_id string")
        return [r.story_idx for r in stories.tag_stories(segs, df, 4).orderBy("seg_pos").collect()]
    assert tags(("0", "gap_2.5"), ("2", "3")) == [0, 0, 0, 1, 1]
    assert tags(("9", "3")) == [None] * 5
    assert tags(("3", "1")) == [None, 0, 0, 0, 0]
    assert tags(("0", "2"), ("1", "3")) == [0, 1, 1, 1, 1]


def test_family_names(spark):
    people = spark.createDataFrame([("p1", "Martha"), ("p2", "Bo")], "person_id string, canonical string")
    aliases = spark.createDataFrame([("p2", "Bemarta"), ("p9", "Zed"), ("p1", "Marda")], "person_id string, token string")
    f = nm.family_names(words(spark, " Marda", " marda", " Martha", " Bemarta's", " tree"), people, aliases)
    got = {r.word_index: (r.match_type, r.person_ids) for r in f.collect()}
    assert got[0] == ("phonetic", ["p1"]) and got[3] == ("alias", ["p2"]) and set(got) == {0, 3}
    assert {(r.token, r.problem) for r in nm.roster_problems(people, aliases).collect()} == {("Zed", "unknown person"), ("Marda", "redundant")}


@pytest.mark.parametrize("tokens, common, flags", [
    (["Zerk", "Zerg"], [], 2), (["Zerk"] * 3 + ["Zerg"], [], 1), (["Zerk"] * 2 + ["Zerg"] * 2, [], 4), (["Cat", "Kat"], [], 0), (["Zerk", "Zerg"], ["zerk", "zerg"], 0)])
def test_inconsistent(spark, tokens, common, flags):
    listed = spark.createDataFrame([(c,) for c in common], "word string")
    f, spellings = nm.inconsistent_names(words(spark, *tokens), S, listed)
    assert f.count() == flags
    if flags == 1:
        assert f.first().majority_spelling == "Zerk" and f.first().majority_count == 3


def test_vote(spark):
    def catch(wrong, *canon):
        return [("s", r, 0, wrong, c) for r, c in enumerate(canon)]
    data = catch("Bondos", "Pandavas", "Pandavas", "Pandav") + catch("Urzi", "X", "X") + catch("Zed", "Bbbb", "Aaaa", "Aaaa", "Bbbb")
    v = ct.vote(spark.createDataFrame(data, "session_id string, round int, line_no int, wrong string, canonical string"), S, 5, 0.5)
    assert rows(v, "key", "canonical", "vote_count") == [("bondos", "Pandavas", 3), ("zed", "Aaaa", 4)]


def gate(spark, canonical, wrong, singles=()):
    flags = spark.createDataFrame([("s", 1, "M9c", canonical, w) for w in wrong], "session_id string, flag_id int, case string, canonical string, key string")
    one = spark.createDataFrame([("s", c) for c in singles], "session_id string, c string")
    common = spark.createDataFrame([("arrow",), ("war",), ("krishna",)], "word string")
    return [r[0] for r in rows(ct.dictionary_gate(flags, one, common, S), "key")]


def test_dictionary_gate(spark):
    assert gate(spark, "Arrow", ["arrows", "urzi"]) == []
    assert gate(spark, "Krishna", ["krishma"]) == ["krishma"]
    assert gate(spark, "Vars", ["wars", "vurs"]) == ["vurs"]
    assert gate(spark, "Arrow", ["arrows"], singles=["arrows", "arrow"]) == ["arrows"]


def test_classify(spark):
    g = spark.createDataFrame([("s", "w", "bushma", "Bhishma", True), ("s", "w", "urzi", "Urjani", False), ("s", "w", "bondos", "X", True)],
                              "session_id string, world string, key string, suggestion string, confident boolean")
    blessed = spark.createDataFrame([("w", "Bondos", "Pandavas", 0)], "world string, form string, canonical string, ordinal int")
    assert rows(ct.classify(g, blessed), "key", "canonical", "action", "method") == [
        ("bondos", "Pandavas", "auto", "dictionary"), ("bushma", "Bhishma", "auto", "sound-alike"), ("urzi", "Urjani", "pending", "judge")]


def decide(spark, blind, heard, blessed=(), start=10.0):
    c = spark.createDataFrame([("s", 0, 0, "w", start, blind)], "session_id string, seg_pos int, word_index int, world string, start double, blind string")
    h = spark.createDataFrame([("s", 0, 0, w, o) for w, o in heard], "session_id string, seg_pos int, word_index int, word string, offset double")
    cast = ct.correction_cast(spark.createDataFrame([("w", "characters", 0, "Bhishma"), ("w", "characters", 1, "Vidura"), ("w", "characters", 2, "Arjuna")], "world string, kind string, rank int, name string"))
    b = spark.createDataFrame(list(blessed), "world string, form string, canonical string, ordinal int")
    common = spark.createDataFrame([("father",), ("arrows",)], "word string")
    none = spark.createDataFrame([], "session_id string, c string")
    d = ct.gate_decisions(c, h, cast, b, none, common, S, 0.7, 1.5)
    return [(r.canonical, r.how, r.action) for r in d.collect()]


def test_correction_gate(spark):
    assert decide(spark, "Bushma", [("Bhishma", 1.5)]) == [("Bhishma", "exact", "auto")]
    assert decide(spark, "arrows", [("Arjuna", 1.4)]) == [("Arjuna", "exact", "queued")]
    assert decide(spark, "fodder", [("father", 1.5)]) == []
    assert decide(spark, "Bushma", [("Bhishma", 2.9)]) == []
    assert decide(spark, "Bushma", [("Bushma", 1.5)]) == []
    assert decide(spark, "Bondos", [], [("w", "bondos", "Pandavas", 0)]) == [("Pandavas", "dictionary", "auto")]


@pytest.mark.parametrize("loud, total, near, codes, cat, lo, hi", [
    (-20, 0.0, -20, [], "ok", 0, 0), (-50, 0.0, -20, [], "drifted", .6, 1), (-50, 0.0, -20, ["M2"], "drifted_coded", .6, 1),
    (-50, 0.0, -50, [], "isolated", .4, .6), (-50, 0.9, -20, [], "quiet_ambiguous", .3, .5)])
def test_drift(spark, loud, total, near, codes, cat, lo, hi):
    df = spark.createDataFrame([(float(loud), float(near), -33.0, total, codes)], "loud_db double, near_db double, threshold double, total double, other_codes array<string>")
    r = dr.classify_drift(df).first()
    assert r.category == cat and lo <= r.score <= hi


def test_noise_floor(spark):
    df = spark.createDataFrame([("s", float(x)) for x in (-50, -45, -30, -20, -10, -40)], "session_id string, db double")
    r = dr.noise_floor(df).first()
    assert (r.floor, r.threshold) == (-45.0, -33.0)


def test_worlds(spark):
    r = spark.createDataFrame([("The Star-Wars Universe!",)], "w string").select(tx.normalize_world("w")).first()
    assert r[0] == "star wars universe"
    st = spark.createDataFrame([("c", "canon", "obvious", "Star Wars", ["SW"]), ("m", "made_up", "subtle", "", [])], "id string, bucket string, difficulty string, world_gold string, world_aliases array<string>")
    said = spark.createDataFrame([("a", "c", "the star wars saga"), ("b", "c", "original"), ("d", "c", "swamp thing"), ("a", "m", "made up"), ("b", "m", "Narnia")], "candidate string, id string, world_pred string")
    assert rows(ev.world_outcomes(st, said), "candidate", "id", "outcome") == [
        ("a", "c", "correct"), ("a", "m", "correct"), ("b", "c", "missed_canon"), ("b", "m", "false_world"), ("d", "c", "wrong_world")]


def test_label_rules(spark):
    schema = "session_id string, seg_id string, codes array<string>"
    l = spark.createDataFrame([("s", "1", ["NotA"]), ("s", "2", ["M9"]), ("s", "3", ["NotA", "M2"])], schema)
    seg = spark.createDataFrame([("s", x) for x in "1234"], "session_id string, seg_id string")
    got = {r.seg_id: (r.codes, r.change) for r in lb.merge_code(l, seg, "M9").collect()}
    assert got == {"1": (["M9"], "replaced"), "2": (["M9"], "already"), "3": (["M2", "M9"], "added"), "4": (["M9"], "new")}
    press = spark.createDataFrame([("s", "1", "NotA"), ("s", "2", "NotA"), ("s", "3", "M2"), ("s", "5", "M1")], "session_id string, seg_id string, code string")
    got = {r.seg_id: r.codes for r in lb.toggle(l, press).collect()}
    assert got == {"2": ["NotA"], "5": ["M1"]}


def test_alignment(spark):
    segs = spark.createDataFrame([("s", 0, "a b c", False, 1.0, 2.0, "A"), ("s", 1, "a b", False, 3.0, 4.0, "A"), ("s", 2, "a", True, 5.0, 6.0, None)],
                                 "session_id string, seg_pos int, text string, is_gap boolean, start double, end double, speaker_label string")
    w = spark.createDataFrame([("s", 0, 0, " a", 1.0, 2.0), ("s", 1, 0, " a", 3.0, 3.5), ("s", 1, 1, " b", 3.5, 4.0)], "session_id string, seg_pos int, word_index int, word string, start double, end double")
    al = spark.createDataFrame([("s", 0, 0, .9, 1.2, .8), ("s", 0, 2, 1.8, 2.4, .6), ("s", 1, 0, 3.1, 3.3, .1), ("s", 1, 1, 3.4, 3.9, .1)],
                               "session_id string, seg_pos int, token_no int, s double, e double, conf double")
    merged, wide = co.alignment_merge(w, segs, al)
    assert rows(merged.filter("seg_pos = 0"), "word_index", "word", "start", "end", "align_conf") == [(0, " a", .9, 1.2, .8), (1, " b", 1.2, 1.2, 0.0), (2, " c", 1.8, 2.4, .6)]
    assert rows(wide, "seg_pos", "status", "start", "end") == [(0, "rescued", .9, 2.4), (1, "realigned", 3.0, 4.0), (2, "untouched", 5.0, 6.0)]
