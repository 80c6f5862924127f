"""Hard-negative mining: rows of another label that score close to an anchor's positives.

Every vector carries the means and deviations of its segments. For two vectors and one segment the
inner product lies within the product of the means, times the length, plus or minus the product of
the deviations; the sum over segments bounds the score. Segments are halved step by step, as long as
that costs less than the scores it may save, and what no bound can rule out is scored exactly.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.words import renewed
from parley.session import staged

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Segments of the first and the last level of bounds.
COARSEST, FINEST = 4, 32
#: Numbers in a slice of rows, anchors of a block, anchors bounded together.
CELLS, ANCHORS, TOGETHER = 1 << 20, 2_048, 32
LARGEST = 2.0**62
#: Products of whole numbers are exact in floating point up to here.
EXACT = 2.0**53
#: Share of an exact score that a level of bounds may always cost; share of pairs alive from which a whole block is multiplied at once.
CHEAP, DENSE = 1 / 8, 1 / 8


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(rid, vec_id, label, v): rows that take part, one number per row, components as whole numbers.

    Rows with a null id, label or vector, or with a null, infinite or NaN component, are left out;
    labels of ids divisible by 7 move on by one.
    """
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("x"))
    whole = rows.filter("vec_id is not null and label is not null and x is not null").filter(
        F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return whole.select(F.monotonically_increasing_id().alias("rid"), "vec_id",
                        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
                        F.transform("x", lambda c: F.floor(c * 256).cast("double")).alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of a column as rows of whole numbers, shorter ones filled with 0.

    Raises where a score could leave the 64-bit range, rather than give a wrong one.
    """
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width))
    out[np.arange(width) < np.diff(np.asarray(lists.offsets))[:, None]] = np.asarray(lists.flatten())
    if len(out) and float((out * out).sum(1).max()) >= LARGEST:
        raise ArithmeticError("components too large: scores would not fit 64 bits")
    return out.astype(np.int64)


def levels(width: int) -> list[int]:
    """Numbers of segments to go through; each divides ``width``."""
    return [s for s in (1 << i for i in range(16)) if COARSEST <= s <= FINEST and width % s == 0 and s < width]


def padded(width: int) -> int:
    """The least multiple of the finest number of segments that holds ``width`` components."""
    return max(1, -(-width // FINEST)) * FINEST


def summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment: sum over the root of its length (so that a product is length x mean x mean), and deviation."""
    parts = x.reshape(len(x), segments, -1).astype(np.float64)
    n = parts.shape[2]
    mean = parts.mean(2)
    return mean * np.sqrt(n), np.sqrt(np.square(parts - mean[:, :, None]).sum(2))


def slack(x: np.ndarray, y: np.ndarray) -> float:
    """More than rounding can add to a bound."""
    most = max((float(np.abs(m).max()) if m.size else 0.0) for m in (x, y))
    return 1e-9 * (1.0 + most * most * x.shape[1])


class Slice:
    """Rows of a task with the summaries of all levels, made once."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.rids, self.labels, self.x, self.real = ids, rids, labels, x, x.astype(np.float64)
        self.levels = [(s, *summary(x, s)) for s in levels(x.shape[1])]
        self.scored = 0

    def bounds(self, anchors: np.ndarray, keep, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, exact scores) of the rows that ``keep`` can't rule out at any level.

        ``wanted`` is the anchor x row mask to start from; ``keep(anchor, low, high)`` marks the rows
        that may still count. A level is asked if its two products a segment cost little beside an exact
        score, or less than the share of the rows that the level before ruled out. While many rows are
        alive, anchors and rows are multiplied as matrices.
        """
        room, alive = slack(anchors, self.x), [np.flatnonzero(w) for w in wanted]
        left, ruled_out = sum(map(len, alive)), 0.0
        for segments, mean, dev in self.levels:
            if not left or 2 * segments > max(CHEAP, ruled_out) * self.x.shape[1]:
                break
            am, ad = summary(anchors, segments)
            dense = left >= DENSE * wanted.size
            mids, offs = (am @ mean.T, ad @ dev.T + room) if dense else (None, None)
            for a, rows in enumerate(alive):
                if len(rows):
                    mid, off = (mids[a][rows], offs[a][rows]) if dense else (mean[rows] @ am[a], dev[rows] @ ad[a] + room)
                    alive[a] = rows[keep(a, mid - off, mid + off)]
            asked, left = left, sum(map(len, alive))
            ruled_out = 1 - left / asked
        self.scored += left
        scores = self.scores(anchors) if left >= DENSE * wanted.size else None
        for a, rows in enumerate(alive):
            yield a, rows, scores[a][rows] if scores is not None else self.x[rows] @ anchors[a]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Scores of all pairs, multiplied as floating point where each partial sum is a whole number that it can hold."""
        real = anchors.astype(np.float64)
        if longest(real) * longest(self.real) >= EXACT / 2:
            return anchors @ self.x.T
        return (real @ self.real.T).astype(np.int64)


def longest(x: np.ndarray) -> float:
    """The greatest length of the vectors."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0)))


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity where there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by descending score, then ascending id."""
    at = np.flatnonzero(scores >= kth(scores, k))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _slice(table: pa.Table, width: int) -> Slice:
    return Slice(table["vec_id"].to_numpy(), table["rid"].to_numpy(), table["label"].to_numpy(), matrix(table["v"], width))


def _nearest(width: int, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        near, x, rids = _slice(rows, width), matrix(anchors["v"], width), anchors["rid"].to_numpy()
        out = [np.zeros((0, 4), np.int64)]
        for at in range(0, len(x), TOGETHER):
            part, own = x[at:at + TOGETHER], rids[at:at + TOGETHER]
            found = near.bounds(part, lambda _, low, high: high >= kth(low, k), own[:, None] != near.rids[None, :])
            for a, found_rows, scores in found:
                top = best(scores, near.ids[found_rows], k)
                hit = found_rows[top]
                out.append(np.column_stack([np.full(len(top), own[a]), near.rids[hit], near.ids[hit], scores[top]]))
        return pa.table(dict(zip(("anchor", "positive", "positive_id", "positive_score"), np.concatenate(out).T, strict=True)))

    return run


def _windows(width: int, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        near, x = _slice(rows, width), matrix(anchors["v"], width)
        rids, labels, pairs = anchors["rid"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
        out = [np.zeros((0, 4), np.int64)]
        for at in range(0, len(x), TOGETHER):
            part = pairs[at:at + TOGETHER]
            limits = [[(-(-LOW * p["s"] // 100), HIGH * p["s"] // 100) for p in ps] for ps in part]

            def keep(a, low, high, limits=limits):
                alive = np.zeros(len(low), bool)
                for lo, hi in limits[a]:
                    sure = low[(low >= lo) & (high <= hi)]
                    alive |= (high >= max(lo, kth(sure, k))) & (low <= hi)
                return alive

            wanted = labels[at:at + TOGETHER, None] != near.labels[None, :]
            for a, found_rows, scores in near.bounds(x[at:at + TOGETHER], keep, wanted):
                # k scores of the window that ends first are in, or below, every window: lower ones are not among its best
                lo, hi = min(limits[a], key=lambda window: window[1])
                high = np.flatnonzero(scores >= kth(scores[(scores >= lo) & (scores <= hi)], k))
                found_rows, scores = found_rows[high], scores[high]
                for p, (lo, hi) in zip(part[a], limits[a], strict=True):
                    inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                    top = inside[best(scores[inside], near.ids[found_rows[inside]], k)]
                    out.append(np.column_stack([np.full(len(top), rids[at + a]), np.full(len(top), p["r"]),
                                                near.ids[found_rows[top]], scores[top]]))
        return pa.table(dict(zip(("anchor", "positive", "negative_id", "negative_score"), np.concatenate(out).T, strict=True)))

    return run


def _dealt(col: str, pieces) -> F.Column:
    """A piece in [0, ``pieces``) from a hash of the row."""
    return F.pmod(F.xxhash64(F.lit(col), F.col("rid")), pieces).cast("int")


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         cells: int = CELLS, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), hardest first.

    Anchors are rows whose id is divisible by ``every``. Blocks of anchors meet slices of rows:
    slices of their own label for the positives, all slices for the negatives, both of bounded size,
    so one label may hold any share of the rows. Rows with a null id, label or vector or with a
    component that is null or not finite take no part. Repeated rows and ids count one by one (each
    is an anchor, a positive and a negative of its own); equal scores go by smaller id. Vectors of
    different length are compared as if the shorter ended in zeros. Anchors without another row of
    their label, and positives without a negative in their window, give no rows; so does an empty
    table. Components so large that a score could leave 64 bits raise an error. Other columns are
    ignored.
    """
    rows = staged(clean_vectors(vectors, id_col, vector_col, label_col))
    size = rows.agg(F.count("rid").alias("n"), F.max(F.size("v")).alias("width"),
                    F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("anchors")).first()
    width = padded(size["width"] or 0)
    per_slice = max(256, cells // width)
    anchors = rows.filter(F.col("vec_id") % every == 0)

    by_label = rows.groupBy("label").agg(
        F.ceil(F.count("rid") / per_slice).cast("int").alias("slices"),
        F.ceil(F.count(F.when(F.col("vec_id") % every == 0, 1)) / block).cast("int").alias("blocks")).filter("blocks > 0")
    key = ["label", "block", "slice"]
    asking = (anchors.join(by_label, "label").withColumn("block", _dealt("block", F.col("blocks")))
              .withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))))
    asked = (rows.join(by_label, "label").withColumn("slice", _dealt("slice", F.col("slices")))
             .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))))
    near = asking.groupBy(*key).cogroup(renewed(asked).groupBy(*key)).applyInArrow(
        _nearest(width, positives), "anchor long, positive long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    chosen = staged(near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= positives).drop("_n"))

    packed = chosen.groupBy("anchor").agg(F.collect_list(F.struct(F.col("positive").alias("r"), F.col("positive_score").alias("s"))).alias("positives"))
    slices, blocks = max(1, -(-size["n"] // per_slice)), max(1, -(-size["anchors"] // block))
    key = ["block", "slice"]
    asking = (anchors.join(packed, F.col("rid") == F.col("anchor")).withColumn("block", _dealt("block", F.lit(blocks)))
              .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).drop("anchor"))
    asked = rows.withColumn("slice", _dealt("slice", F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asking.groupBy(*key).cogroup(renewed(asked).groupBy(*key)).applyInArrow(
        _windows(width, negatives), "anchor long, positive long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (ranked.join(chosen, ["anchor", "positive"]).join(names, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
