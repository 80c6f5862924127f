"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel. Every partition sums its part of the normal equations
in whole numbers, so the model doesn't depend on the order of rows or on retries; a rising step
curve (isotonic regression) turns its output into a probability.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.hashing import chunks
from parley.llm.language_id import held_out
from parley.session import staged

SEED, FEATURES, WIDTH, RIDGE, CLIP = 13, 192, 4.0, 1e-3, 6.0
THRESHOLD = 0.3
#: A feature is stored as a whole number of 2 ** -FIXED; outputs of the model fall into BINS bins over [LOW, HIGH).
FIXED, BINS, LOW, HIGH = 14, 4_096, -0.5, 1.5
#: One in this many training rows sets the calibration and not the weights.
CALIBRATION = 4

#: Character classes by byte, and the statistics of a text.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "symbol", "bracket", "other", "beyond")
_SETS = {"space": b" \t\r\v\f", "newline": b"\n", "stop": b".?", "comma": b",;:'\"-", "bang": b"!", "symbol": b"#*$%&|", "bracket": b"<>()[]{}/\\=+_@~^`"}
STATISTICS = ("log_words", "word_bytes", "distinct", "repeated", "log_lines", "duplicate_lines", "shouted", *CLASSES)


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    table[97:123], table[65:91], table[48:58], table[128:] = (CLASSES.index(c) for c in ("lower", "upper", "digit", "beyond"))
    for name, members in _SETS.items():
        table[list(members)] = CLASSES.index(name)
    return table


_TABLE = _class_table()


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text, over whole texts; null counts as empty."""
    out = np.zeros((len(texts), len(STATISTICS)))
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    for at, end, found in chunks(texts):
        kinds = _TABLE[found.data]
        edges = np.append(0, np.cumsum(sizes[at:end], dtype=np.int64))
        for i in range(end - at):
            a, b = int(edges[i]), int(edges[i + 1])
            w, v = int(found.first[i]), int(found.first[i + 1])
            counts = np.bincount(kinds[a:b], minlength=len(CLASSES))
            hashes, n = found.hashes[w:v], v - w
            triples = found.spans(np.arange(w, v - 2), np.arange(w + 3, v + 1)) if n > 2 else hashes[:0]
            rows = found.data[a:b].tobytes().split(b"\n")
            lines = [r for r in rows if r.strip()]
            letters = counts[0] + counts[1]
            out[at + i] = [np.log1p(n), _share(int((found.ends[w:v] - found.starts[w:v]).sum()), n), _share(len(np.unique(hashes)), n),
                           1.0 - _share(len(np.unique(triples)), len(triples)) if len(triples) else 0.0, np.log1p(len(lines)),
                           1.0 - _share(len(set(lines)), len(lines)) if lines else 0.0, _share(int(counts[1]), int(letters)),
                           *(np.sqrt(counts / max(1, b - a)))]
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for batch in batches:
        rows = statistics(batch.column(2))
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
        x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel())).cast(kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["doc_id", "held_out", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, x): the statistics of every text."""
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return keyed.mapInArrow(_measure, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, held_out boolean, x array<double>")


def lift(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics as whole numbers, a constant one last."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    weights, phase = rng.standard_normal((len(STATISTICS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.column_stack([np.rint(np.cos(z @ weights + phase) * 2.0**FIXED), np.full(len(z), 2.0**FIXED)])


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def _normal_equations(mean: np.ndarray, scale: np.ndarray):
    """Map function: (i, j, s) of a partition's sums of products, i <= j; the label is feature FEATURES + 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((FEATURES + 2, FEATURES + 2), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):  # 4096 x 2 ** 28 stays exact in a double
                part = batch.slice(at, 4096)
                z = lift(_rows(part.column(0)), mean, scale)
                z = np.column_stack([z, np.asarray(part.column(1)) * 2.0**FIXED])
                total += (z.T @ z).astype(np.int64)
                size += len(z)
        if size:
            i, j = np.triu_indices(FEATURES + 2)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    return run


def solve(sums: np.ndarray, rows: int, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights from the sums of products; the constant isn't penalised."""
    gram, right = sums[:-1, :-1] / rows, sums[:-1, -1] / rows
    penalty = np.full(len(gram), ridge)
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), right)


def isotonic(x: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, share) of the rising step curve nearest to ``hits / n``, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for at, size, good in zip(x, n, hits, strict=True):
        pools.append([at * size, size, good])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


@dataclass(frozen=True)
class Model:
    """Standardisation, ridge weights over the features, and the knots of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    shares: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The bin of the uncalibrated output."""
        y = lift(x, self.mean, self.scale) @ self.weights / 2.0**FIXED
        return np.clip(np.floor((y - LOW) / (HIGH - LOW) * BINS), 0, BINS - 1).astype(np.int32)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.shares), 0.0, 1.0)


def _apply(model: Model, what: str):
    """Map function: the first columns of a row and the model's ``what`` ('raw' or 'score') of the last one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = getattr(model, what)(_rows(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], [*batch.schema.names[:-1], what])

    return run


def train(rows: DataFrame) -> Model | None:
    """The model of rows (mark, x, y); None without any.

    One row in ``CALIBRATION``, by its mark, is left to the calibration. All rows are used; what
    reaches the driver is one row per pair of features and one per bin.
    """
    k = len(STATISTICS)
    moments = rows.agg(F.count("y").alias("n"), *[F.round(f(F.col("x")[i]), 6).alias(f"{name}{i}")
                                                  for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return None
    mean, scale = (np.array([moments[f"{name}{i}"] for i in range(k)], float) for name in "ms")
    scale[scale == 0] = 1.0
    kept = F.col("mark") % CALIBRATION != 0
    sums, size = np.zeros((FEATURES + 2, FEATURES + 2)), 0
    fitting = rows.filter(kept).select("x", F.col("y").cast("double"))
    total = fitting.mapInArrow(_normal_equations(mean, scale), "i int, j int, s long").groupBy("i", "j").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for r in total.collect():
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = float(r["s"]) / 4.0**FIXED
    size = sums[FEATURES, FEATURES]
    weights = solve(sums, size) if size else np.zeros(FEATURES + 1)
    blank = Model(mean, scale, weights, np.zeros(1), np.zeros(1))
    seen = (rows.filter(~kept) if size else rows).select("y", "x").mapInArrow(_apply(blank, "raw"), "y int, raw int")
    bins = sorted(seen.groupBy("raw").agg(F.count("y").alias("n"), F.sum("y").alias("hits")).collect())
    if not bins:
        return Model(mean, scale, weights, np.array([0.0, BINS]), np.array([LOW, HIGH]))
    at, n, hits = (np.array(c, float) for c in zip(*bins, strict=True))
    return Model(mean, scale, weights, *isotonic(at, n, hits))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its text alone.

    Learns from labels of ids whose crc32 leaves a remainder by 5. A label is the majority of its
    id's rows, 1 on a tie; null labels and labels without a document are ignored. Null text counts
    as empty; empty and blank texts get the score of their statistics; a null id is held out;
    repeated rows get equal scores. Without a label to learn from every score is 0.5. An empty
    table gives no rows, other columns are ignored, texts of any length are read whole.
    """
    seen = staged(measured(docs, id_col, text_col))
    one = (labels.filter(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id"))
           .agg((F.avg(F.col(f"`{label_col}`")) >= 0.5).cast("int").alias("y")))
    mark = F.crc32(F.concat(F.lit("calibrate:"), F.col("doc_id").cast("string")))
    model = train(seen.filter(~F.col("held_out")).join(one, "doc_id").select(mark.alias("mark"), "x", "y"))
    if model is None:
        scored = seen.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        scored = seen.mapInArrow(_apply(model, "score"), f"doc_id {seen.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
