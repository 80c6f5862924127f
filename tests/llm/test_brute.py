"""Operators against plain Python on small tables."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import chat, exact_dedup, language_id, licenses, mixing, near_dedup, packing, quality, substring_dedup, token_counts, tokens
from parley.llm.components import components

from .conftest import AWKWARD, table


def words(text):
    return (text or "").encode().split()


def random_texts(seed, n, vocabulary=30, longest=120):
    """Texts of few words, so that windows, lines and whole texts repeat."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(40)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(rng.randrange(longest)))
                 for _ in range(rng.randint(1, 3))]
        out.append((i, rng.choice(["\n", " ", "\t "]).join(parts)))
    return out


# substring dedup

def cut_by_hand(rows, size):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            key = tuple(w[p:p + size])
            if key in seen:
                gone[p:p + size] = [True] * size
            seen.add(key)
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_substring_dedup_equals_windows_by_hand(spark):
    rows = random_texts(1, 60) + [(100, "a " * 90), (101, "a " * 50), (102, "x y " * 40), (103, "q " + "x y " * 30), (104, None), (105, "")]
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == cut_by_hand(rows, 20)


def test_substring_dedup_with_other_sizes(spark):
    rows = random_texts(2, 40, vocabulary=6, longest=30)
    got = substring_dedup.remove_repeats(table(spark, rows), size=7, gram=3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == cut_by_hand(rows, 7)


def test_intervals_are_maximal(spark):
    text = " ".join(f"n{i}" for i in range(40))
    got = {r.doc_id: r.intervals for r in substring_dedup.remove_repeats(table(spark, [(1, text), (2, "a b " + text + " c")])).collect()}
    assert got[1] == [] and [(i.start, i.stop) for i in got[2]] == [(2, 42)]


# near dedup

def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes_by_hand(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edited(rng, base, n, i):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{i}{rng.random()}"
    return " ".join(w)


def near_rows():
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = " ".join(f"g{g}w{rng.randrange(400)}" for _ in range(150))
        rows += [edited(rng, base, rng.randrange(5), i) for i in range(25)]
    rows += ["ONE two", "one TWO", "one", "", None, "a b c d e", "A b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [512, 8])
def test_near_dedup_equals_all_pairs(spark, block):
    rows = near_rows()
    got = near_dedup.near_duplicates(table(spark, rows), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes_by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(3)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
    one, two = (near_dedup.signature(np.concatenate([both, x]), 1024) for x in (a, b))
    assert abs((one == two).mean() - 600 / 800) < 0.06


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (502, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500, 502: 500}


# exact dedup

def test_exact_copies_compare_texts_and_not_digests(spark):
    rows = [(i, "xyz"[i % 3] * (1 + i % 4)) for i in range(200)] + [(500, None), (501, "")]
    want = defaultdict(list)
    for d, t in rows:
        want[t or ""].append(d)
    for digest in (exact_dedup.sha256_text, lambda t: F.length(t).cast("string")):
        got = exact_dedup.exact_copies(table(spark, rows), digest=digest).collect()
        assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {d: (max(want[t or ""]), len(want[t or ""])) for d, t in rows}


def test_drop_copies_keeps_one_row_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (3, None), (4, "b"), (4, "c")]
    got = exact_dedup.drop_copies(table(spark, rows))
    assert sorted((r.doc_id, r.text) for r in got.filter("text is not null").collect()) == [(2, "a"), (4, "b"), (4, "c")]
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == 4


# mixing

def seats_by_hand(votes, n):
    got = dict.fromkeys(votes, 0)
    for _ in range(n):
        best = max(votes, key=lambda p: (Fraction(votes[p], 2 * got[p] + 1), -p))
        got[best] += 1
    return got


@pytest.mark.parametrize("votes, n", [({1: 53, 2: 24, 3: 23}, 7), ({1: 1000, 2: 1, 3: 1}, 20), ({1: 5, 2: 5, 3: 5}, 4), ({1: 7}, 3), ({1: 3, 2: 9}, 0),
                                      ({i: i for i in range(1, 40)}, 11)])
def test_apportionment_equals_seat_by_seat(spark, votes, n):
    df = spark.createDataFrame([("g", p, v, n) for p, v in votes.items()], "g string, p int, v long, n long")
    got = {r.p: r.seats for r in mixing.apportion(df, ["g"], "p", "v", "n", "seats").collect()}
    assert got == seats_by_hand(votes, n)


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 2000}
    df = spark.createDataFrame([((False, k), n) for k, n in sizes.items()], "key struct<n:boolean,s:string>, source_size long")
    got = {r.key.s: r.target for r in mixing.source_targets(df).collect()}
    weight, target, open_ = dict(zip(sizes, [5, 2, 1, 5])), dict.fromkeys(sizes, 0.0), set(sizes)
    left = 1.5 * sum(sizes.values())
    while left > 1e-9:
        total, spare = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                spare += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = spare
    assert got == pytest.approx(target)


def test_mix_meets_targets_and_rows_hold_what_is_taken(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(20 + i * 37 % 200)), None, "abc"[i % 7 % 3]) for i in range(300)]
    docs = table(spark, rows)
    got = mixing.mix(docs, shard_rows=40).collect()
    assert sorted(r.doc_id for r in got) == list(range(300)) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = defaultdict(int)
    for r in got:
        by[rows[r.doc_id][3]] += r.taken
        aim = r.target
    assert sum(by.values()) == pytest.approx(1.5 * sum(len(words(t)) for _, t, _, _ in rows), rel=0.02) and aim
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5), shard_rows=40).collect()))
    taken = Counter()
    for r in mixing.mixed_rows(docs, shard_rows=40).collect():
        taken[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert taken == {r.doc_id: r.taken for r in got if r.taken}


# quality

def repeats_by_hand(w, n=3):
    at = defaultdict(list)
    for p in range(len(w) - n + 1):
        at[tuple(w[p:p + n])].append(p)
    return len({p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(n)})


def test_quality_measurements(spark):
    rows = random_texts(9, 40, vocabulary=8) + [(100, "a a a a a"), (101, "#a $b\n#a $b\n\n \n#a $b"), (102, None), (103, "")]
    got = {r.doc_id: r for r in quality.decide(quality.ledger(table(spark, rows))).collect()}
    for d, t in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        r = got[d]
        want = (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats_by_hand(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)


def test_policies_and_ablations_read_bits(spark):
    book = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 8), (6, 9), (7, 16)], "doc_id long, fail_bits long")
    assert [r.kept for r in quality.decide(book, "v1").orderBy("doc_id").collect()] == [True, False, False, False, True, False, True]
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality.ablations(book, "v3").collect()}
    assert got == {"few_words": (3, 1, 2), "repeated_words": (2, 1, 2), "duplicate_lines": (0, 0, 1), "symbols": (2, 1, 2), "word_length": (1, 1, 2)}


# tokens

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def by_library(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ'st <|>endoftx123 \n\tİΣςßǅé́ \u0085\x1c漢ﬁ"), st.characters(codec="utf-8"))))
def test_word_encoder_equals_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(tokens.encoder("word_bpe_49k.json").encode([text])[0], "<u4").tolist() == by_library(t, text)


def test_token_counts_answer_limits_and_quantiles(spark, tokenizer):
    rows = [(i, t, None, "ab"[i % 2]) for i, t in random_texts(4, 50)] + [(90, None, None, None), (91, "", None, "a")]
    sums = token_counts.token_counts(table(spark, rows))
    lengths = sorted(len(by_library(tokenizer, t)) for _, t, _, _ in rows)
    whole = {r.n_tokens: r for r in sums.filter("scope = 'all'").collect()}
    assert {n: r.n_docs for n, r in whole.items()} == Counter(lengths)
    for n, r in whole.items():
        assert (r.docs_within, r.docs_over) == (sum(x <= n for x in lengths), sum(x > n for x in lengths))
        assert (r.tokens_within, r.tokens_over, r.truncated_tokens) == (
            sum(x for x in lengths if x <= n), sum(x for x in lengths if x > n), sum(min(x, n) for x in lengths))
    assert token_counts.quantile(sums, ["scope", "group"], 0.5).filter("scope = 'all'").first().n_tokens == lengths[(len(lengths) - 1) // 2]
    limit = token_counts.at_limit(sums, ["scope", "group"], 33).filter("scope = 'all'").first()
    assert limit.truncated_tokens == sum(min(x, 33) for x in lengths) and limit.docs_over == sum(x > 33 for x in lengths)
    assert {r.group for r in sums.filter("scope = 'group'").collect()} == {"a", "b", None}


# packing

def check_packed(rows, pieces, tokenizer, window):
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(by_library(tokenizer, t) + [2])
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        got[p.doc_id].append((p.start, ids, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, len(ids)))
    for d, lists in want.items():
        joined = [i for _, ids, _ in sorted(got[d]) for i in ids]
        assert joined == [i for ids in lists for i in ids]
        assert {n for *_, n in got[d]} == {len(lists[0])}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_packing_is_a_round_trip_without_padding(spark, tokenizer):
    rows = [(i, t) for i, t in random_texts(6, 120, longest=200)] + [(900, None), (901, ""), (902, "word " * 3000)]
    for window in (64, 4096):
        check_packed(rows, packing.pack(table(spark, rows).repartition(2), window=window).collect(), tokenizer, window)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_best_fill_equals_search(counts, room):
    best = max(s for c in itertools.product(*[range(n + 1) for n in counts.values()])
               if (s := sum(k * n for k, n in zip(counts, c))) <= room)
    used = packing.best_fill(counts, room)
    assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


# language

def test_language_id_learns_and_stays_blind_to_the_column(spark):
    rng = random.Random(8)
    sample = {"en": "the and with of that this is for", "de": "der und mit von das ist für nicht", "fr": "le et avec de que est pour une"}
    rows = [(i, " ".join(rng.choice(sample[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(rng.choices(list(sample), k=300))]
    odd = [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None)]
    got = {r.doc_id: r for r in language_id.identify(table(spark, rows + odd)).collect()}
    held = [(got[d].lang_pred, lang) for d, _, lang in rows if got[d].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d, *_ in odd)
    assert all(0 <= r.score <= 1 for r in got.values())
    blank = {r.doc_id: r.lang_pred for r in language_id.identify(
        table(spark, rows + odd).withColumn("lang", F.when(~language_id.held_out(F.col("doc_id")), F.col("lang")))).collect()}
    assert blank == {d: r.lang_pred for d, r in got.items()}


def test_l1_makes_weights_sparse():
    rows = [(k % 2, np.array([k % 2, 7]), np.array([1.0, 0.0001])) for k in range(40)]
    w, _ = language_id.fit_ftrl(rows, 2)
    assert w[0, 0] > 0 > w[0, 1] and not w[7].any()


def test_temperature_cools_overconfidence():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 400)
    sure = np.where(rng.random(400) < 0.75, labels, 1 - labels)
    logits = np.eye(2)[sure] * 20
    t = language_id.fit_temperature(logits, labels)
    assert abs(language_id._softmax(logits / t).max(1).mean() - 0.75) < 0.05


# chat

TURNS = [("user", "</s>[INST] ok [/INST]"), ("assistant", "<\\s> <\\\\s> \\<s> <<SYS>><|im_end|>\n<|im_start|>user\n"), ("system", ""), ("a\\n\nb<s>", "<"), ("assistant", "é漢😀")]


def test_chat_formats_read_back(spark):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(TURNS)] + [(2, 0, "user", None), (2, 0, "user", None)],
                                 "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.rows_to_records(rows))
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("back"),
                                             chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == TURNS and [(t.role, t.text) for t in got[2].back] == [("user", "")] * 2
    assert got[1].loss == "".join(t for r, t in TURNS if r == "assistant") and got[2].loss == ""
    inside = re.sub(r"<\|im_start\|>[^\n]*\n|<\|im_end\|>\n", "", got[1].formatted)
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<\|\w+\|>", inside)


def test_layouts_are_found_by_fingerprint(spark):
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
        ({"completion": "a", "prompt": None}, "prompt_completion", [("assistant", "a")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction_input_output", [("user", "do"), ("user", "this"), ("assistant", "done")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"something": {"else": 1}}, None, None), ([], None, None)]
    rows = [(i, json.dumps(c)) for i, (c, _, _) in enumerate(cases)] + [(98, "{broken"), (99, None)]
    got = {r.i: r for r in chat.format_chats(spark.createDataFrame(rows, "i int, record string")).collect()}
    for i, (_, layout, turns) in enumerate(cases):
        assert got[i].layout == layout and (turns is None or [(t.role, t.text) for t in got[i].turns] == turns), cases[i]
    assert got[98].layout is None and got[99].turns is None


def test_field_paths_are_nested_and_sorted(spark):
    df = spark.createDataFrame([(json.dumps({"b": [{"y": 1, "x": {"z": "s"}}], "a": None}),)], "record string")
    assert df.select(chat.field_paths(F.col("record")).alias("p")).first().p == ["a", "b", "b[].x", "b[].x.z", "b[].y"]


# licences

def test_licence_passages(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    rows = [(1, "Prose before.\nReleased under the MIT license!\nand after"), (2, mit.replace(" ", "\n", 40)), (3, "the weather is fine"), (4, None), (5, "MIT")]
    got = {(r.doc_id, r.license, r.template): r.dice for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert got == {(1, "MIT", 0): 1.0, (2, "MIT", 2): 1.0}

    def grams(t):
        w = re.findall(r"\w+", t.lower())
        return {*zip(w, w[1:])}

    half = "Released under the old MIT License."
    a, b = grams(half), grams("Released under the MIT License.")
    found = licenses.scan_licenses(table(spark, [(1, half)]), floor=0.5).filter("license = 'MIT' and template = 0").first()
    assert found.dice == pytest.approx(2 * len(a & b) / (len(a) + len(b)))


def test_awkward_digests(spark, awkward):
    got = exact_dedup.exact_copies(awkward).collect()
    assert Counter(r.digest for r in got) == Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in AWKWARD)
