"""Source divergence audit: how far the term shares of a language's sources lie apart.

Terms are counted in one pass over the texts, kept terms get dense numbers inside segments of
bounded size, and every unordered pair of sources is priced once per segment by a galloping merge
of two sorted (term number, count) arrays; a segment's prices are summed afterwards.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.words import renewed
from parley.operators.skew import keyed_lookup
from parley.session import staged

MIN_DOCS, SMOOTHING, TOP = 30, 5, 50
#: Kept terms of a segment, sources of a bucket, words of a text held at once, terms a task holds before it hands them on.
SEGMENT, BUCKET, PIECE, HELD = 8_192, 16, 1 << 20, 1_000_000

#: Tasks that share a language's rows where a table with one row per language is looked up.
SPREAD = 32

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, about ``PIECE`` bytes at a time; no term is cut."""
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= PIECE else plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task, in parts of about ``HELD`` terms; each group also under the term ''."""
    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in counts.items():
            n = len(c) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n),
                 pa.array([b"", *c], pa.binary()).cast(pa.string()), pa.array([0, *c.values()], pa.int64()),
                 pa.array([0, *map(docs[lang, source].__getitem__, c)], pa.int64())], ["lang", "source", "term", "n", "docs"])

    counts, docs, held = {}, {}, 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            group = (lang, source)
            if group not in counts:
                counts[group], docs[group] = Counter(), Counter()
            seen, before = set(), len(counts[group])
            for terms in _pieces(text.as_py()):
                counts[group].update(terms)
                seen.update(terms)
            docs[group].update(seen)
            held += 1 + len(counts[group]) - before
            if held > HELD:
                yield from emit()
                counts, docs, held = {}, {}, 0
    yield from emit()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; each group also with the term ''."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"))],
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    parts = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS, segment: int = SEGMENT) -> DataFrame:
    """(lang, term, n, v, total, segment, k): a language's kept terms, its totals over them, and each term's place.

    ``v`` is the number of kept terms and ``total`` the sum of their occurrences; ``k`` numbers the
    terms of a segment from 0. Segments hold about ``segment`` terms however many a language has.
    """
    kept = (counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .filter(F.col("docs") >= min_docs).drop("docs"))
    totals = kept.groupBy("lang").agg(F.count("term").alias("v"), F.sum("n").alias("total"))
    placed = keyed_lookup(kept, totals, ["lang"], ["term"], spread=SPREAD).withColumn("segment", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / segment)).cast("int"))
    return placed.withColumn("k", (F.row_number().over(Window.partitionBy("lang", "segment").orderBy("term")) - 1).cast("int"))


def share(n, total, v):
    """1 + floor(10^9 (n + 5) / (total + 5 v)) of whole numbers, in SQL.

    The division goes digit by digit in base 1000, so it is exact for totals up to 9 * 10^15.
    """
    whole = f"({total} + {SMOOTHING} * {v})"
    rest, quotient = f"({n} + {SMOOTHING})", "0L"
    for step in range(4):
        here = rest if step == 0 else f"({rest} * 1000)"
        quotient, rest = f"({quotient} * 1000 + {here} div {whole})", f"({here} % {whole})"
    return F.expr(f"1 + {quotient}")


def _share(n: np.ndarray, total: int, v: int) -> np.ndarray:
    """``share`` over an array."""
    whole = np.int64(total + SMOOTHING * v)
    quotient, rest = np.divmod(n + np.int64(SMOOTHING), whole)
    for _ in range(3):
        more, rest = np.divmod(rest * np.int64(1000), whole)
        quotient = quotient * np.int64(1000) + more
    return quotient + np.int64(1)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values in two strictly ascending arrays, the first not longer than the second.

    Each value of the shorter array is sought in the longer one by steps that double from where the
    last one was found, all values a stride at a time: the halves meet in between them.
    """
    found = np.empty(len(short), np.int64)
    todo = [(0, len(short), 0, len(long))]
    while todo:
        a, b, lo, hi = todo.pop()
        if b - a <= 64 or hi - lo <= 4 * (b - a):
            found[a:b] = lo + np.searchsorted(long[lo:hi], short[a:b])
            continue
        mid = (a + b) // 2
        step = 1
        while lo + step < hi and long[lo + step] < short[mid]:
            step *= 2
        start = lo + step // 2
        at = start + int(np.searchsorted(long[start:min(lo + step, hi)], short[mid]))
        found[mid] = at
        todo += [(a, mid, lo, min(at + 1, hi)), (mid + 1, b, at, hi)]
    hit = found < len(long)
    hit[hit] = long[found[hit]] == short[hit]
    return np.flatnonzero(hit), found[hit]


def price(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], v: int, terms: int) -> int:
    """Sum of |p - q| over the ``terms`` terms of a segment, from the (numbers, counts, total) of two groups.

    Terms of both groups are priced from the intersection, those of one group against the other's
    share of an absent term, and those of neither all at once.
    """
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ka, na, ta), (kb, nb, tb) = a, b
    pa_, pb_ = _share(na, ta, v), _share(nb, tb, v)
    za, zb = (int(_share(np.zeros(1, np.int64), t, v)[0]) for t in (ta, tb))
    ia, ib = gallop(ka, kb)
    both = np.abs(pa_[ia] - pb_[ib]).sum()
    only_a = np.abs(pa_ - zb).sum() - np.abs(pa_[ia] - zb).sum()
    only_b = np.abs(pb_ - za).sum() - np.abs(pb_[ib] - za).sum()
    return int(both + only_a + only_b) + (terms - len(ka) - len(kb) + len(ia)) * abs(za - zb)


def _pair_task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """All unordered pairs between two buckets of sources, over one segment of one language."""
    rows = []
    for x in left.itertuples():
        for y in right.itertuples():
            if x.i != x.j or x.source < y.source:
                value = price((np.asarray(x.ks, np.int32), np.asarray(x.ns, np.int64), x.total),
                              (np.asarray(y.ks, np.int32), np.asarray(y.ns, np.int64), y.total), x.v, x.terms)
                rows.append((x.lang, x.source, y.source, value))
    return pd.DataFrame(rows, columns=["lang", "a", "b", "value"])


def pair_values(groups: DataFrame, arrays: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(lang, a, b, value) of every unordered pair of sources that share a segment.

    Sources lie in hash buckets of about ``bucket``; a task takes two buckets and one segment, so
    a segment's arrays travel once per other bucket and not once per other source.
    """
    buckets = groups.groupBy("lang").agg(F.ceil(F.count("source") / bucket).cast("int").alias("nb"))
    dealt = keyed_lookup(arrays, buckets, ["lang"], ["source", "segment"], spread=SPREAD).withColumn("_b", F.pmod(F.xxhash64("source"), F.col("nb")).cast("int"))
    key = ["lang", "segment", "i", "j"]
    left = dealt.withColumn("j", F.explode(F.sequence(F.col("_b"), F.col("nb") - 1))).withColumnRenamed("_b", "i")
    right = renewed(dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_b")))).withColumnRenamed("_b", "j"))
    return (left.groupBy(*key).cogroup(right.groupBy(*key))
            .applyInPandas(_pair_task, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", segment: int = SEGMENT, bucket: int = BUCKET) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part ``pair``: every other source of the language with the summed distance of shares over all
    kept terms. Part ``term``: the ``top`` terms that the group uses more than its language, by how
    much. Null text, lang and source count as ''; each row is a document, repeated rows too; a
    document without terms still makes its group occur; equal values are ranked by item in UTF-8
    order; other columns are ignored; an empty table gives no rows. A language without kept terms
    has distance 0 between all its sources. A text of any length is read whole, in pieces.
    """
    counts = staged(term_counts(docs, text_col, lang_col, source_col))
    kept = staged(kept_terms(counts, min_docs, segment))
    held = staged(counts.filter("term <> ''").drop("docs").join(
        kept.select("lang", "term", "segment", "k", "v", F.col("n").alias("lang_n"), F.col("total").alias("lang_total")), ["lang", "term"]))
    groups = counts.filter("term = ''").select("lang", "source")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = staged(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]))

    over = (held.join(groups, ["lang", "source"])
            .withColumn("value", share("n", "total", "v") - share("lang_n", "lang_total", "v")).filter("value > 0"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = (over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))

    lists = held.groupBy("lang", "source", "segment").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("_l"))
    segments = kept.groupBy("lang", "segment", "v").agg(F.count("term").cast("int").alias("terms"))
    none = F.array().cast("array<struct<k:int,n:bigint>>")
    arrays = (groups.join(segments, "lang").join(lists, ["lang", "source", "segment"], "left")
              .withColumn("_l", F.coalesce("_l", none)).select("*", F.col("_l.k").alias("ks"), F.col("_l.n").alias("ns")).drop("_l"))
    bare = groups.join(kept.select("lang").distinct(), "lang", "left_anti")
    apart = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang").filter("a < b")
    priced = pair_values(groups, arrays, bucket).unionByName(apart.withColumn("value", F.lit(0).cast("long")))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (priced.select("lang", "value", ways.alias("_w"))
             .select("lang", "_w.source", F.lit("pair").alias("part"), "_w.item", "value")
             .withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank"))
    return pairs.unionByName(terms)
