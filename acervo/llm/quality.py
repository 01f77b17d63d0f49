"""Quality classifier: Naive Bayes support vectors.

Indicators of byte n-grams are scaled by class log-count ratios; a linear hinge-loss model is fitted to them by dual
coordinate descent, and its margins become probabilities through a fitted sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm._text import pieces

#: Hashed n-gram buckets, n-gram sizes in bytes, and documents per indicator matrix.
BUCKETS, SIZES, BLOCK = 1 << 16, (1, 2, 3), 128
#: Labelled rows that the fit takes at most.
FIT_ROWS = 6000


@dataclass
class Model:
    """Weights of scaled indicators, squared scales, and the sigmoid's slope and offset."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float


def _indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, matrix): which n-gram buckets each of up to BLOCK texts has."""
    for lo in range(0, len(offsets) - 1, BLOCK):
        bounds = offsets[lo : lo + BLOCK + 1]
        found = np.zeros((len(bounds) - 1, BUCKETS), np.uint8)
        flat = found.reshape(-1)
        for a in range(int(bounds[0]), int(bounds[-1]), 1 << 20):
            b = min(a + (1 << 20), int(bounds[-1]))
            at = np.arange(a, b)
            text = np.searchsorted(bounds, at, "right") - 1
            left = bounds[text + 1] - at
            code = np.zeros(b - a, np.uint32)
            for k, n in enumerate(range(1, max(SIZES) + 1)):
                part = data[a + k : min(b + k, len(data))].astype(np.uint32)
                code[: len(part)] = code[: len(part)] * np.uint32(257) + part + np.uint32(1)
                if n in SIZES:
                    whole = left >= n
                    slot = (code[whole] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(16)
                    flat[text[whole] * BUCKETS + slot] = 1
        yield lo, found


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                for lo, found in _indicators(data, offsets):
                    rows = part.slice(lo, len(found))
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), pa.array([np.flatnonzero(x).astype("<u2").tobytes() for x in found], pa.binary())], ["id", "label", "buckets"])

    return docs.mapInArrow(run, "id long, label int, buckets binary")


def _descend(rows: list[np.ndarray], y: np.ndarray, squares: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on unit-length scaled rows with a constant feature.

    Gives the weights of the indicators (those of the scaled rows times the scales), so that no row's values are held.
    """
    lengths = np.array([max(float(np.sqrt(squares[x].sum())), 1e-12) for x in rows])
    norms = np.array([float(squares[x].sum()) for x in rows]) / lengths**2 + 1
    w, bias, alpha, random = np.zeros(len(squares)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    upper = cost * np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(rounds):
        most = 0.0
        for i in random.permutation(len(y)):
            x = rows[i]
            slack = y[i] * (float(w[x].sum()) / lengths[i] + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), upper[i])
            if step := (new - alpha[i]) * y[i]:
                w[x] += step / lengths[i] * squares[x]
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of good, by Newton steps on smoothed targets."""
    n, m = good.sum(), (~good).sum()
    target = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum() + 1e-3 * slope, d.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def held_out(id_column: Column) -> Column:
    """Rows that no fit may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", fit_rows: int = FIT_ROWS, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> Model:
    """Fit to `fit_rows` labelled rows at most: those with the lowest seeded hash of the id that are not held out.

    Rows without label, id or text are left out; of repeated labels of an id the smallest holds, of its texts the one with
    the smallest hash. With no labels, or one class only, the model gives the share of that class (0.5 without labels).
    """
    sample = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    sample = sample.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("text is not null")
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # Arrow keeps all rows in a few large buffers, which go back to the system after the fit
    found = _features(one).toArrow().sort_by("id").combine_chunks()
    good = found.column("label").to_numpy() == 1
    share = (good.sum() + 0.5) / (len(good) + 1)
    if good.all() or not good.any():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    rows = [np.frombuffer(x.as_buffer(), "<u2") for x in found.column("buckets")]
    counts = np.ones((2, BUCKETS))
    for x, label in zip(rows, good, strict=True):
        counts[int(label), x] += 1
    scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = _descend(rows, np.where(good, 1.0, -1.0), scale**2, cost, rounds, seed)
    margins = np.array([float(w[x].sum()) / max(float(np.sqrt((scale[x] ** 2).sum())), 1e-12) + bias for x in rows])
    slope, offset = _sigmoid(margins, good)
    return Model(w, scale**2, bias, slope, offset)


def score_rows(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns `keep` of each row of docs, and `score`: the probability of label 1 for the whole text.

    One pass without a shuffle. Null texts count as empty; an empty text has no indicators and gets the score of the bias
    alone. A column named score is not kept.
    """
    keep = [c for c in keep if c != "score"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        both = np.stack([m.weights, m.squares], axis=1).astype(np.float32)
        for batch in batches:
            for part, data, offsets in pieces(batch, text_column):
                for lo, found in _indicators(data, offsets):
                    sums = (found.astype(np.float32) @ both).astype(np.float64)
                    margin = sums[:, 0] / np.maximum(np.sqrt(sums[:, 1]), 1e-12) + m.bias
                    score = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -30, 30)))
                    rows = part.slice(lo, len(found))
                    yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(score)], [*keep, "score"])

    needed = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_column])]
    return docs.select(needed).mapInArrow(run, ", ".join([*[f"`{c}` {fields[c]}" for c in keep], "score double"]))


def score_quality(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, score) for each row of docs, as score_rows. Repeated rows and null ids come out as they come in; other
    columns are not read."""
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return score_rows(plain, model, ["id"]).withColumnRenamed("id", id_column)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; predicted is 1 from `threshold` on."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
