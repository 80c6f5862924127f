"""Random small inputs against plain Python, with blocks small enough to cut every group."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import phonetic as ph
from parley.operators import catches as ct
from parley.operators import evaluate as ev
from parley.operators import filters as fl
from parley.operators import intervals as iv
from parley.operators import stories as st
from parley.operators.asof import asof, bracket
from parley.operators.components import connected_forms
from parley.operators.drift import percentile_of
from parley.operators.runs import number_runs
from parley.operators.scans import LastSeen, Next, NextSeen, Prev, RunMax, RunSum, block_of, ordered_text, scan

SEEDS = [1, 2, 3]
S = ["session_id"]


def values(seed, n=60):
    rng = random.Random(seed)
    pos = sorted(rng.sample(range(200), n))
    return [("ab"[rng.random() < 0.3], p, rng.choice([None, rng.randint(-5, 5)])) for p in pos]


@pytest.mark.parametrize("seed", SEEDS)
def test_scan(spark, seed):
    data = values(seed)
    df = spark.createDataFrame(data, "session_id string, pos int, x int").repartition(5)
    x = F.col("x")
    out = scan(df, S, ["pos"], block_of("pos", 7), prev=Prev(x), next=Next(x), total=RunSum(x), before=RunSum(x, inclusive=False),
               top=RunMax(x), last=LastSeen(x), upto=LastSeen(x, inclusive=True), first=NextSeen(x), from_=NextSeen(x, inclusive=True))
    got = {(r.session_id, r.pos): r for r in out.collect()}
    assert len(got) == len(data)
    for key in "ab":
        rows = [(p, v) for s, p, v in data if s == key]
        for i, (p, v) in enumerate(rows):
            r = got[(key, p)]
            past, future = [y for _, y in rows[:i]], [y for _, y in rows[i + 1:]]
            known, ahead = [y for y in past if y is not None], [y for y in future if y is not None]
            assert r.prev == (past[-1] if past else None) and r.next == (future[0] if future else None)
            assert r.total == sum(known) + (v or 0) and r.before == sum(known)
            assert r.top == (max(known) if known else None)
            assert r.last == (known[-1] if known else None) and r.upto == (v if v is not None else r.last)
            assert r["first"] == (ahead[0] if ahead else None) and r.from_ == (v if v is not None else r["first"])


@pytest.mark.parametrize("seed", SEEDS)
def test_runs_and_text(spark, seed):
    data = values(seed)
    df = spark.createDataFrame(data, "session_id string, pos int, x int")
    runs = number_runs(df, S, ["pos"], block_of("pos", 5), F.signum("x"), prev_name="p")
    got = {(r.session_id, r.pos): (r.run, r.p) for r in runs.collect()}
    sign = lambda v: None if v is None else (v > 0) - (v < 0)
    for key in "ab":
        run, prev = 0, "none"
        for _, p, v in [d for d in data if d[0] == key]:
            run += sign(v) != prev if prev != "none" else 1
            assert got[(key, p)] == (run, None if prev == "none" else prev)
            prev = sign(v)
    text = ordered_text(df, S, ["pos"], F.col("pos").cast("string"), block_of("pos", 9), ",")
    want = {k: ",".join(str(p) for s, p, _ in data if s == k) for k in "ab"}
    assert {r.session_id: r.text for r in text.collect()} == {k: v for k, v in want.items() if v}


def spans(seed, n=40, top=100):
    rng = random.Random(seed)
    return [(rng.choice("ab"), a, a + rng.randint(0, 12), i) for i, a in enumerate(rng.randint(0, top) for _ in range(n))]


@pytest.mark.parametrize("seed", SEEDS)
def test_overlaps_merges_and_pieces(spark, seed):
    left, right = spans(seed), spans(seed + 100, 30)
    a = spark.createDataFrame(left, "session_id string, start int, end int, id int")
    b = spark.createDataFrame(right, "session_id string, start int, end int, id int")
    r = b.select("session_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("rid"))
    for width in (3, 50):
        for closed in (False, True):
            got = sorted((x.id, x.rid) for x in iv.overlap_join(a, r, S, width, closed=closed).collect())
            hit = (lambda p, q: p[1] <= q[2] and q[1] <= p[2]) if closed else (lambda p, q: p[1] < q[2] and q[1] < p[2])
            assert got == sorted((p[3], q[3]) for p in left for q in right if p[0] == q[0] and hit(p, q))
        cover = {k: {t for s, x, y, _ in right if s == k for t in range(x, y)} for k in "ab"}
        merged = iv.merge_intervals(b, S, width)
        rows = merged.collect()
        for k in "ab":
            mine = sorted((x.start, x.end, x.prev_end) for x in rows if x.session_id == k)
            assert {t for s, e, _ in mine for t in range(s, e)} == cover[k]
            assert all(n[0] > p[1] and n[2] == p[1] for p, n in zip(mine, mine[1:])) and mine[0][2] is None
        again = iv.merge_intervals(merged, S, width)
        assert sorted((x.session_id, x.start, x.end) for x in again.collect()) == sorted((x.session_id, x.start, x.end) for x in rows)
        left_over = iv.subtract(a, b, S, width).collect()
        for k, s, e, i in left:
            bits = sorted((x.start, x.end) for x in left_over if x.id == i)
            assert {t for x, y in bits for t in range(x, y)} == set(range(s, e)) - cover[k]
            assert all(p[1] < n[0] for p, n in zip(bits, bits[1:]))


@pytest.mark.parametrize("seed", SEEDS)
def test_nearest(spark, seed):
    probes, builds = spans(seed, 25, 60), spans(seed + 7, 25, 60)
    p = spark.createDataFrame(probes, "session_id string, start int, end int, id int")
    b = spark.createDataFrame(builds, "session_id string, start int, end int, id int")
    got = {r.id: (r.prev_id, r.next_id) for r in bracket(p, b, S, ["id"], "id", 6).collect()}
    loose = {r.id: r.b_id for r in asof(p, b, S, "start", "start", "id", ["id"], 6, "backward", False).collect()}
    tight = {r.id: r.b_id for r in asof(p, b, S, "end", "start", "id", ["id"], 6, "forward", True).collect()}
    for k, s, e, i in probes:
        mine = [x for x in builds if x[0] == k]
        back = min((x for x in mine if x[1] < s), key=lambda x: (-x[1], x[3]), default=None)
        fwd = min((x for x in mine if x[1] >= e), key=lambda x: (x[1], x[3]), default=None)
        assert got[i] == (back and back[3], fwd and fwd[3])
        eq = min((x for x in mine if x[1] <= s), key=lambda x: (-x[1], x[3]), default=None)
        after = min((x for x in mine if x[1] > e), key=lambda x: (x[1], x[3]), default=None)
        assert loose[i] == (eq and eq[3]) and tight[i] == (after and after[3])


def walk(events, n):
    """The story walk, one event at a time."""
    out, opened = [], None
    for _, p, kind in sorted(events, key=lambda e: (e[0], e[1], e[2] != "end")):
        if kind == "start":
            if opened is None:
                opened = p
            elif p - 1 >= opened:
                out.append((opened, p - 1))
                opened = p
        else:
            if opened is None:
                opened = min(out[-1][1] + 1 if out else 0, p)
            out.append((opened, max(opened, p)))
            opened = None
    if opened is not None:
        out.append((opened, n - 1))
    return out or [(0, n - 1)]


@pytest.mark.parametrize("seed", range(4))
def test_story_assembly(spark, seed):
    rng = random.Random(seed)
    sets = {f"s{k}": sorted({(z, max(0, z * 3 + rng.randint(-3, 4)), rng.choice(["start", "start", "end"])) for z in range(rng.randint(0, 9))}) for k in range(12)}
    ev_rows = [(k, *e) for k, es in sets.items() for e in es]
    e = spark.createDataFrame(ev_rows, "session_id string, zone int, pos long, kind string")
    n = spark.createDataFrame([(k, 40) for k in sets], "session_id string, n_lines long")
    got = {}
    for r in st.assemble_stories(e, n, 2).collect():
        got.setdefault(r.session_id, []).append((r.start_pos, r.end_pos))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(walk(es, 40)) for k, es in sets.items()}


@pytest.mark.parametrize("seed", SEEDS)
def test_story_matching(spark, seed):
    truth, pred = spans(seed, 18, 40), spans(seed + 50, 18, 40)
    t = spark.createDataFrame([(k, i, a, b) for k, a, b, i in truth], "session_id string, story_idx int, start_pos int, end_pos int")
    p = spark.createDataFrame([(k, i, a, b) for k, a, b, i in pred], "session_id string, pred_idx int, start_pos int, end_pos int")
    want = set()
    for key in "ab":
        used = set()
        for _, a, b, i in sorted((x for x in truth if x[0] == key), key=lambda x: (x[1] - x[2], x[3])):
            best = max(((min(b, y) - max(a, x) + 1, -j) for k, x, y, j in pred if k == key and j not in used and x <= b and a <= y), default=None)
            if best:
                used.add(-best[1])
                want.add((i, -best[1]))
    assert {(r.story_idx, r.pred_idx) for r in ev.match_stories(t, p, 8).collect()} == want


@pytest.mark.parametrize("seed", SEEDS)
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.choice("ab"), f"f{rng.randint(0, 25):02d}", f"c{rng.randint(0, 30)}") for _ in range(45)]
    edges += [("a", f"x{i:02d}", f"k{j}") for i in range(20) for j in (i, i + 1)]     # a long chain
    got = {(r.session_id, r.form): r.cluster_id for r in connected_forms(spark.createDataFrame(edges, "session_id string, form string, code string"), S).collect()}
    label = {(s, f): f for s, f, _ in edges}
    for _ in range(60):
        for s, f, c in edges:
            peers = [x for t, x, d in edges if t == s and d == c]
            low = min(label[(s, x)] for x in peers)
            for x in peers:
                label[(s, x)] = low
    assert got == label


@pytest.mark.parametrize("seed", SEEDS)
def test_percentile_and_copies(spark, seed):
    import numpy as np
    rng = random.Random(seed)
    data = [(rng.choice("ab"), rng.choice([-3.0, 1.5, 2.25, rng.random() * 10])) for _ in range(50)]
    df = spark.createDataFrame(data, "session_id string, db double")
    got = {r.session_id: r.percentile for r in percentile_of(df, S, "db", 0.2, F.floor("db")).collect()}
    for k in "ab":
        assert got[k] == pytest.approx(np.percentile([v for s, v in data if s == k], 20))
    texts = [("s", i, rng.choice(["one", "two", "three", " "])) for i in range(40)]
    seen, later = set(), []
    for _, i, t in texts:
        if t.strip():
            (later.append(i) if t in seen else seen.add(t))
    t = spark.createDataFrame(texts, "session_id string, seg_pos int, text string")
    assert sorted(r.seg_pos for r in fl.duplicate_segments(t, S, "seg_pos", block_of("seg_pos", 6)).collect()) == later


def test_controls_and_near_codes(spark):
    rng = random.Random(5)
    words = [("s", i, f"w{i}", i * 3) for i in range(97)] + [("t", i, f"w{i}", i) for i in range(9)]
    keys = [("s", 0, 150), ("t", 1, 400)]
    w = spark.createDataFrame(words, "session_id string, word_id int, word string, start int")
    k = spark.createDataFrame(keys, "session_id string, note_id int, at int")
    got = {(r.session_id, r.word_id) for r in ev.controls(w, k, 10, 12, 8, 16).collect()}
    free = {s: [x for x in words if x[0] == s and all(abs(x[3] - a) >= 12 for t, _, a in keys if t == s)] for s in "st"}
    want = {("s", free["s"][int(i * (len(free["s"]) / 10))][1]) for i in range(10)} | {("t", x[1]) for x in free["t"]}
    assert got == want
    codes = ["".join(rng.choice("PTKSM") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    df = spark.createDataFrame([(c,) for c in set(codes)], "c string")
    for k in (1, 2):
        a = df.withColumn("g", F.explode(ct._deletions(F.col("c"), k)))
        b = a.select(F.col("c").alias("d"), "g")
        near = {(r.c, r.d) for r in a.join(b, "g").filter(F.levenshtein("c", "d", k) >= 0).select("c", "d").distinct().collect()}
        every = {(r.c, r.d) for r in df.crossJoin(df.select(F.col("c").alias("d"))).filter(F.levenshtein("c", "d") <= k).collect()}
        assert near == every


def test_partitioning_does_not_matter(spark):
    data = [("s", 0, i, w) for i, w in enumerate("Zerk Zerg Mola Mula Zerk tree".split())]
    base = spark.createDataFrame(data, "session_id string, seg_pos int, word_index int, word string")
    from parley.operators import names as nm
    none = spark.createDataFrame([], "word string")
    seen = {tuple(sorted((r.word_index, r.cluster_id) for r in nm.inconsistent_names(base.repartition(n), S, none, codes=ph.skeleton_codes)[0].collect())) for n in (1, 7)}
    assert len(seen) == 1
