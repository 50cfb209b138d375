"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are the distinct character 1- to 3-grams and the distinct 1- to 3-grams of word shapes
(case, digits, punctuation, length, repetition of an earlier word), hashed to a fixed table. Indicators are
scaled by the log ratio of their smoothed rates in both classes, rows are scaled to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve on the margin gives the score.

The model is fitted on at most ``sample_rows`` labelled rows, chosen by a hash of their ids; scoring reads every
row and whole texts. Only the text is an input.

Defined results: null or empty texts have no features and get the score of the bias alone; with no labelled
rows, or rows of one class only, every score is that class's share (0.5 without rows); other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

TABLE_BITS = 18
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
_MASK = np.uint32((1 << TABLE_BITS) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h = h ^ (h >> np.uint32(12))
    return (h * np.uint32(0x297A2D39)) >> np.uint32(32 - TABLE_BITS)


class Shapes(dict):
    """Word to shape code; emptied when it holds too many words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        core = word.strip(".,;:!?\"'()")
        end = word[-1]
        if core.isalpha():
            marks, digit = len(word) - len(core), False
        else:
            marks, digit = sum(not c.isalnum() for c in word), any(c.isdigit() for c in word)
        code = min(len(core), 12) | (word[:1].isupper() << 4) | ((len(core) > 1 and core.isupper()) << 5) | (digit << 6)
        code |= (0 if end.isalnum() else ".,!?;:|#%&$*-".find(end) + 2) << 7
        self[word] = code = code | (min(marks, 5) << 12)
        return code


def features(text: str | None, shapes: Shapes, last: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of a whole text. ``last``: an int32 table for the place where each was met last."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    parts = []
    for seed, grams in ((1, 1), (2, 2), (3, 3)):
        if len(raw) >= grams:
            h = raw[: len(raw) - grams + 1] + np.uint32(1000 * seed)
            for k in range(1, grams):
                h = h * np.uint32(2654435761) + raw[k : len(raw) - grams + 1 + k]
            parts.append(_mix(h * np.uint32(0x9E3779B1)))
    words = (text or "").split()
    if words:
        codes = np.fromiter(map(shapes.__getitem__, words), np.uint32, len(words))
        same = np.fromiter(map(str.__eq__, words[1:], words), bool, len(words) - 1)
        codes[1:][same] |= np.uint32(1 << 16)
        # how much of the text repeats earlier words, in sixteenths
        again = (len(words) - len(set(words))) / len(words)
        parts.append(_mix(np.array([int(again * 16) + 77_000], np.uint32) * np.uint32(0x85EBCA6B)))
        for grams in (1, 2, 3):
            if len(codes) >= grams:
                h = codes[: len(codes) - grams + 1] + np.uint32(500_000 * grams)
                for k in range(1, grams):
                    h = h * np.uint32(0xC2B2AE35) + codes[k : len(codes) - grams + 1 + k]
                parts.append(_mix(h * np.uint32(0x27D4EB2F)))
    if not parts:
        return np.empty(0, np.int32)
    every = np.concatenate(parts)
    at = np.arange(len(every), dtype=np.int32)
    last[every] = at
    return every[last[every] == at].astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # by feature, already times the log-count ratio
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        r = self.ratio[f]
        norm = float(np.sqrt(np.dot(r, r)))
        return self.bias + (float(self.weights[f].sum()) / norm if norm else 0.0)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 4.0, epochs: int = 12, seed: int = 7) -> Model:
    """Dual coordinate descent for the hinge loss over scaled indicators; ``y`` holds 0 and 1."""
    size = 1 << TABLE_BITS
    zero = np.zeros(size, np.float32)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 0.01, 0.99))
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.ones((2, size))
    for f, label in zip(rows, y):
        counts[label, f] += 1
    rates = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(rates[1] / rates[0]).astype(np.float32)
    signs = np.where(y == 1, 1.0, -1.0)
    bound = cost * np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    norms = [float(np.sqrt(np.dot(ratio[f], ratio[f]))) or 1.0 for f in rows]
    v = np.zeros(size)  # weights over unscaled indicators: sum of alpha * sign * ratio / norm
    alpha, bias, rng = np.zeros(len(y)), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, s = rows[i], signs[i]
            r = ratio[f]
            gradient = s * (float(np.dot(v[f], r)) / norms[i] + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), bound[i])  # a unit row and a unit bias: squared length 2
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                v[f] += step * r / norms[i]
                bias += step
                alpha[i] = new
    model = Model((v * ratio).astype(np.float32), ratio, bias, 1.0, 0.0)
    margins = np.array([model.margin(f) for f in rows])
    # Logistic calibration by Newton's method, against smoothed targets
    p, n = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        w, e = q * (1 - q) + 1e-9, q - goal
        h = np.array([[np.dot(w, margins**2) + 1e-6, np.dot(w, margins)], [np.dot(w, margins), w.sum() + 1e-6]])
        da, dc = np.linalg.solve(h, [np.dot(e, margins), e.sum()])
        a, c = a - da, c - dc
        if abs(da) + abs(dc) < 1e-9:
            break
    model.slope, model.shift = float(a), float(c)
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels are not used: crc32 of the id as text leaves no remainder. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``docs`` (id, text) with at most ``sample_rows`` of ``labels`` (id, y), those of the smallest id hashes.

    The labels chosen are at most ``sample_rows`` and so are broadcast: texts are not shuffled. Of documents that
    repeat an id, the smallest text is used.
    """
    order = F.xxhash64("id", F.lit(11))
    ids = labels.join(docs.select("id").distinct(), "id", "left_semi").withColumn("h", order).orderBy("h", "id").limit(sample_rows).select("id", "y")
    ids = written(ids, "quality-sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, last = Shapes(), np.zeros(1 << TABLE_BITS, np.int32)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([c.column("y"), pa.array([features(t, shapes, last).tobytes() for t in c.column("text").to_pylist()], pa.binary())], ["y", "f"])

    def fitted(t: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.int32) for x in t["f"].to_pylist()]
        m = fit(rows, t["y"].to_numpy().astype(np.int64))
        return pa.table({"w": [m.weights.tobytes()], "r": [m.ratio.tobytes()], "b": [m.bias], "a": [m.slope], "c": [m.shift]})

    sample = docs.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text")
    sample = written(sample.mapInArrow(extract, "y int, f binary"), "quality-features")
    got = sample.groupBy(F.lit("all")).applyInArrow(fitted, "w binary, r binary, b double, a double, c double").first()
    if got is None:
        return fit([], np.array([], np.int64))
    return Model(np.frombuffer(got.w, np.float32), np.frombuffer(got.r, np.float32), got.b, got.a, got.c)


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "_score") -> DataFrame:
    """``docs`` with the score of every whole text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, last = Shapes(), np.zeros(1 << TABLE_BITS, np.int32)
        for b in batches:
            margins = np.array([model.margin(features(t, shapes, last)) for t in b.column(b.schema.get_field_index(text)).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(margins), pa.float64())], [*b.schema.names, score])

    return docs.mapInArrow(add, type(docs.schema)([*docs.schema.fields]).add(score, "double"))


def usable_labels(labels: DataFrame) -> DataFrame:
    """id, y of the labels that may be used. Of repeated labels for an id, the larger counts."""
    y = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("y"))
    return y.filter(~held_out(F.col("id")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train(docs.select(F.col("doc_id").alias("id"), "text"), usable_labels(labels))
    out = with_score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    model = train(docs.select(F.col("doc_id").alias("id"), "text"), usable_labels(labels))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    out = with_score(plain, model, f"c{names.index('text')}")
    return out.filter(F.col("_score") >= threshold).drop("_score").toDF(*names)
