"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights come from follow-the-regularised-leader with elastic-net penalties, probabilities from a
temperature fitted on rows that the weights haven't seen.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_BITS = 16
GRAMS = (1, 2, 3)
SAMPLE_ROWS = 4_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
SCALE = 30.0
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages, (feature x language) weights with the IDF folded in, biases, temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def features(text: str) -> np.ndarray:
    """Hashed character n-grams of a lower-cased text, one entry per occurrence."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    grams, parts = np.zeros(len(code), np.uint32), []
    for n in range(1, max(GRAMS) + 1):
        grams = grams[:len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1:]
        if n in GRAMS:
            x = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            parts.append((x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - FEATURE_BITS))
        if len(grams) < 2:
            break
    return np.concatenate(parts)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n) of one task; the number of its texts stands under feature -1."""
    df, rows = np.zeros(1 << FEATURE_BITS, np.int64), 0
    seen = np.zeros(1 << FEATURE_BITS, bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen[:] = False
            seen[features(text)] = True
            df += seen
            rows += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], ["feature", "n"])


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, language, features, term frequencies) of the sampled texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [np.unique(features(t), return_counts=True) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([f.astype(np.int32) for f, _ in found], pa.list_(pa.int32())),
                 pa.array([(c / c.sum()).astype(np.float32) for _, c in found], pa.list_(pa.float32()))],
                ["mark", "language", "features", "tf"])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (class, features, values): per-coordinate rates, L1 zeroes, L2 shrinks. Returns weights and biases."""
    size = (1 << FEATURE_BITS) + 1
    z, n = np.zeros((size, n_classes)), np.zeros((size, n_classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, at, x in rows:
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[label] -= 1.0
            g = x[:, None] * error
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    final = weights(slice(None))
    return final[:-1], final[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by narrowing a grid of its logarithm."""
    low, high, best = -3.0, 4.0, 0.0
    for _ in range(6):
        grid = np.linspace(low, high, 15)
        loss = [-np.log(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
        best = float(grid[int(np.argmin(loss))])
        low, high = best - (high - low) / 14, best + (high - low) / 14
    return float(np.exp(best))


def _fit(languages: list[str], idf: np.ndarray):
    """Map function over the one partition of sampled rows: a single row with the model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: k for k, name in enumerate(languages)}
        rows = [(mark, place[lang], np.asarray(f, np.int64), np.asarray(tf, np.float64))
                for b in batches for mark, lang, f, tf in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: r[0])
        scaled = [(label, at, tf * idf[at] * SCALE) for _, label, at, tf in rows]
        fitting = [r for r, (mark, *_) in zip(scaled, rows, strict=True) if mark % 4] or scaled
        held = [r for r, (mark, *_) in zip(scaled, rows, strict=True) if mark % 4 == 0] or scaled
        weights, bias = fit_ftrl(fitting, len(languages))
        logits = np.array([x @ weights[at] + bias for _, at, x in held])
        temperature = fit_temperature(logits, np.array([label for label, _, _ in held]))
        folded = (weights * idf[:, None] * SCALE).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([folded.tobytes()]), pa.array([bias.astype(np.float32).tobytes()]), pa.array([temperature])],
                                         ["weights", "bias", "temperature"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of all rows with a text and a language; None without such rows.

    Document frequencies are counted over all of them. The weights are fitted on a sample of about
    ``sample_rows`` rows, an equal number per language (its rows are drawn by a hash of the id);
    a quarter of it sets the temperature. The bound holds whatever the input's size; the model is
    at most 2 ** FEATURE_BITS numbers per language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    counts = {r["language"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("language")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    found = known.select(text_col).mapInArrow(_document_frequency, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros((1 << FEATURE_BITS) + 1)
    for r in found.collect():
        df[r["feature"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    mark = F.crc32(F.concat(F.lit("sample:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    quota = sample_rows / len(languages)
    rate = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, quota / counts[name]))])
    drawn = (known.select(mark.alias("mark"), F.col(lang_col).alias("language"), F.col(text_col).alias("text"))
             .filter(F.col("mark") < F.element_at(rate, F.col("language")) * F.lit(2.0**32)))
    sparse = drawn.mapInArrow(_sparse_rows, "mark long, language string, features array<int>, tf array<float>")
    got = sparse.repartition(1).mapInArrow(_fit(languages, idf), "weights binary, bias binary, temperature double").collect()
    if not got:
        return None
    row = got[0]
    return Model(languages, np.frombuffer(row["weights"], np.float32).reshape(-1, len(languages)),
                 np.frombuffer(row["bias"], np.float32), row["temperature"])


def has_letter(text: Column) -> Column:
    """False for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from whole texts alone.

    ``und`` with score 0 for null texts, texts without a letter, and without a model.
    """
    schema = [f"`{c}` {t}" for c, t in docs.dtypes if c not in ("lang_pred", "score")]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    if model is None:
        return kept.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    flagged = kept.withColumn("_letters", has_letter(F.col(text_col)))
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.ascontiguousarray(model.weights.T)
        for batch in batches:
            texts, letters = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
            named, score = [], []
            for i, ok in enumerate(letters):
                if not ok:
                    named.append(UNKNOWN)
                    score.append(0.0)
                    continue
                f = features(texts[i].as_py())
                logits = np.array([c[f].sum() for c in columns]) / len(f) + model.bias
                p = _softmax(logits / model.temperature)
                best = int(p.argmax())
                named.append(model.languages[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(score, pa.float64())],
                                             [*batch.schema.names[:-1], "lang_pred", "score"])

    return flagged.mapInArrow(run, ", ".join([*schema, "lang_pred string", "score double"]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows that training never sees: crc32 of the id as text leaves no remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Trained on the rows that aren't held out, predicted on all. Repeated rows have equal answers;
    an empty table gives no rows; columns other than those named are ignored.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                        held_out(F.col(id_col)).alias("held_out"))
    model = train(keyed.filter(~F.col("held_out")), "doc_id")
    return predict(keyed.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   languages: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` predicted as one of ``languages`` (any, where it is None) with a score of at least ``floor``.

    Columns stay as they are. A row's own label decides nothing about it; without any labelled row no row is kept.
    """
    model = train(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)])
    judged = predict(named, model, f"_{docs.columns.index(text_col)}").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= floor))
    if languages is not None:
        judged = judged.filter(F.col("lang_pred").isin(list(languages)))
    return judged.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])
