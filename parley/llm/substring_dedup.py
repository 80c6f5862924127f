"""Substring dedup: Rabin-Karp hashes of word windows, counted in Spark, merged to removal intervals."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.hashing import WORD_BASE, chunks, mix64
from parley.session import staged

WINDOW, GRAM = 20, 5
FLUSH = 1 << 20
PART_BITS = 32
NO_ID = -(2**63)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def anchored_runs(words, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, first window, windows) of each anchor of a chunk of texts.

    A window's anchor is its least gram hash; equal windows have equal anchors at equal places. The
    windows of a text that share an anchor's place are one run of neighbours.
    """
    width = size - gram + 1
    at, text = words.windows(size)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    n = len(words.hashes)
    starts = np.arange(n - gram + 1)
    grams = words.spans(starts, starts + gram)
    least = np.zeros(len(grams), np.uint64)
    least[at] = _slide(grams, width, np.minimum)[at]
    valid = np.zeros(len(grams), bool)
    valid[at] = True
    owner = np.zeros(n, np.int64)
    owner[at] = text
    padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, np.uint64(0))])
    anchor = np.flatnonzero((_slide(padded, width, np.maximum) == grams))
    first, last = np.full(len(anchor), -1), np.full(len(anchor), -1)
    for back in range(width):
        p = anchor - back
        hit = (p >= 0) & valid[p] & (least[p] == grams[anchor])
        first[hit] = p[hit]
        last[hit & (last < 0)] = p[hit & (last < 0)]
    held = first >= 0
    anchor, first, last = anchor[held], first[held], last[held]
    return owner[first], grams[anchor], first, last - first + 1


def _batch(columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _runs(size: int, gram: int):
    """Map function: rows (h, r, k, s, m, later) of runs; equal (h, r) of a flush but the first are later copies.

    Those need no comparison and travel under a hash of their place, so a passage that stands in
    many documents sends one row per flush to the task that compares its runs.
    """
    def flush(parts) -> pa.RecordBatch:
        h, r, k, s, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((s, k, r, h))
        h, r, k, s, m = h[order], r[order], k[order], s[order], m[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = (k != k[lead]) | (s != s[lead])
        h = np.where(later, mix64(k.view(np.uint64) * np.uint64(WORD_BASE) + s.view(np.uint64)), h)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(r.view(np.int64)), pa.array(k), pa.array(s), pa.array(m.astype(np.int32)), pa.array(later)],
            ["h", "r", "k", "s", "m", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, part = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for at, end, words in chunks(batch.column(2)):
                text, h, first, m = anchored_runs(words, size, gram)
                if not len(text):
                    continue
                r = words.spans(first, first + m + size - 1)
                s = (part[at:end][text] << PART_BITS) + first - words.first[text]
                parts.append((h, r, ids[at:end][text], s, m))
                held += len(text)
                if held > FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _marks(runs: DataFrame) -> DataFrame:
    """(k, s, m, later) of the runs that repeat an earlier one, and of first runs under an anchor of several.

    What a run needs to know of its anchor and of its equals comes from aggregates, which combine on
    the map side; the runs themselves meet one row per key in joins, which Spark splits where a key is hot.
    """
    place, open_ = F.struct("k", "s"), runs.filter("not later").drop("later")
    anchors = open_.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("r") != F.max("r")).alias("mixed")).filter("n > 1").drop("n")
    shared = staged(open_.join(anchors.hint("merge"), "h"))
    firsts = shared.groupBy("h", "r").agg(F.min(place).alias("first"))
    judged = shared.join(firsts.hint("merge"), ["h", "r"]).withColumn("later", place != F.col("first")).filter("later or mixed")
    return judged.select("k", "s", "m", "later").unionByName(runs.filter("later").select("k", "s", "m", "later"))


def _windows(size: int):
    """Map function: rows (w, k, p, later) of the windows of undecided runs; later: an equal one is earlier in the flush."""
    def flush(parts) -> pa.RecordBatch:
        w, k, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((p, k, w))
        w, k, p = w[order], k[order], p[order]
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
        later = (k != k[lead]) | (p != p[lead])
        w = np.where(later, mix64(k.view(np.uint64) * np.uint64(WORD_BASE) + p.view(np.uint64)), w)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(k), pa.array(p), pa.array(later)], ["w", "k", "p", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, part = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            open_s, open_m = batch.column(3), batch.column(4)
            for at, end, words in chunks(batch.column(2)):
                for i in range(at, end):
                    s, m = (np.asarray(x[i].as_py(), np.int64) for x in (open_s, open_m))
                    mine = s >> PART_BITS == part[i]
                    s, m = s[mine] & ((1 << PART_BITS) - 1), m[mine]
                    if len(s):
                        p = np.unique(np.repeat(s, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
                        base = words.first[i - at]
                        parts.append((words.spans(base + p, base + p + size), np.full(len(p), ids[i]), (part[i] << PART_BITS) + p))
                        held += len(p)
                if held > FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _cut(size: int):
    """Map function: per text its words, the removed intervals, and the kept words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1).to_pylist()
            cols = [batch.column(c).to_pylist() for c in range(2, 6)]
            n_words, intervals, kept = [], [], []
            for i, (text, s, m, p) in enumerate(zip(*cols, strict=True)):
                words = (text or "").encode().split()
                n_words.append(len(words))
                starts = np.concatenate([np.asarray(s or [], np.int64), np.asarray(p or [], np.int64)])
                spans = np.concatenate([np.asarray(m or [], np.int64), np.ones(len(p or []), np.int64)])
                mine = starts >> PART_BITS == part[i]
                starts, spans = starts[mine] & ((1 << PART_BITS) - 1), spans[mine]
                if not len(starts):
                    intervals.append([])
                    kept.append(b" ".join(words).decode())
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + spans + size - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                intervals.append([{"start": int(a), "stop": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                kept.append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()),
                 pa.array(intervals, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())],
                ["k", "n_words", "intervals", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, intervals (removed word ranges), kept_text.

    A word goes when a window of ``size`` words around it starts earlier somewhere (smaller id, or
    same document and earlier). All windows are hashed; which hashes repeat is settled in two steps:

    1. Windows are held in runs that share their least ``gram``-word hash (their anchor). A run
       equal to an earlier run is a repeat as a whole; an anchor that only equal runs share is
       settled. All windows under an anchor that occurs once occur once.
    2. Windows of the remaining first runs, of anchors in differing surroundings, are compared
       one by one; the earliest of equal hashes stays.

    Hashes have 64 bits. Both steps drop later copies inside a map task first, so a passage in many
    documents sends one row per task and not one per document. Texts move once, by id. Words are
    runs of other than ASCII white space.

    Null and empty texts have no words; a null id counts as the smallest (and so does -2**63);
    rows that share an id are parts of one document in order of 31 bits of their text's hash
    (windows don't span parts), and fully equal rows count as one and the same; an empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"),
                       F.shiftrightunsigned(F.xxhash64(text), 33).alias("part"), text.alias("text"))
    spot = F.struct("k", "p")
    runs = staged(rows.mapInArrow(_runs(size, gram), "h long, r long, k long, s long, m int, later boolean"))
    marks = staged(_marks(runs))
    entry = F.struct("s", "m")
    undecided = marks.filter("not later").groupBy("k").agg(F.collect_list(entry).alias("open"))
    moved = rows.repartition("k")
    windows = (moved.join(undecided, "k").select("k", "part", "text", F.col("open.s").alias("s"), F.col("open.m").alias("m"))
               .mapInArrow(_windows(size), "w long, k long, p long, later boolean").repartition("w"))
    first = F.min(spot).over(Window.partitionBy("later", "w"))
    gone = windows.withColumn("first", first).filter(F.col("later") | (spot != F.col("first"))).groupBy("k").agg(F.collect_list("p").alias("p"))
    whole = marks.filter("later").groupBy("k").agg(F.collect_list(entry).alias("later"))
    joined = (moved.join(whole, "k", "left").join(gone, "k", "left")
              .select("k", "part", "text", F.col("later.s").alias("s"), F.col("later.m").alias("m"), "p"))
    cut = joined.mapInArrow(_cut(size), "k long, n_words long, intervals array<struct<start:long,stop:long>>, kept_text string")
    removed = F.aggregate("intervals", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return cut.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "n_words", removed.alias("n_removed"), "intervals", "kept_text")
