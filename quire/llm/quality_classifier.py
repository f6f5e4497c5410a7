"""Quality classifier: a linear model on n-grams scaled by naive Bayes log-count ratios (NBSVM).

Features of a text are the presence of hashed n-grams: words and word pairs (A-Z lower-cased), and runs of one to
three word shapes (classes of characters, repeats folded), plus buckets of its length and of its share of distinct
words. In training each indicator is scaled by its smoothed log-count ratio between the classes; a linear model is
then fitted with hinge loss by dual coordinate descent, and its margin is turned into a probability by a logistic
curve fitted on margins of folds that were left out.

Learning uses TRAINING_ROWS labelled rows at most (those with the least hash of their id), a documented bound;
every document is scored whole. Labels, language, source and id are never inputs of a score.

Cases: null or empty text has only its two bucket features, and still a score. A document with several labels
counts as good if any says 1; null labels teach nothing. With labels of one class only, or none, the score is that
class's smoothed share. Repeated rows are scored one by one. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .hashing import mix, word_hashes

TRAINING_ROWS, BITS, COST, EPOCHS, FOLDS, THRESHOLD, SMOOTH, SEED = 6000, 18, 0.1, 12, 4, 0.3, 1.0, 5
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct hashed features of a text, ascending."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    _, _, w = word_hashes(raw.lower())
    shape = _SHAPE[np.frombuffer(raw, dtype=np.uint8)]
    if len(shape):
        shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])]
    _, _, s = word_hashes(shape.tobytes())
    share = len(np.unique(w)) / len(w) if len(w) else 0.0
    parts = [np.array([int(np.log2(len(w) + 1) * 2) + 1, 1000 + int(share * 20)], dtype=np.uint64)]
    with np.errstate(over="ignore"):
        k = np.uint64(0x100000001B3)
        parts += [w, w[:-1] * k + w[1:] + np.uint64(1), s + np.uint64(2)]
        if len(s) > 1:
            parts.append(s[:-1] * k + s[1:] + np.uint64(3))
        if len(s) > 2:
            parts.append((s[:-2] * k + s[1:-1]) * k + s[2:] + np.uint64(4))
        return np.unique(mix(np.concatenate([p.astype(np.uint64) for p in parts])) & np.uint64((1 << bits) - 1)).astype(np.int32)


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss model over scaled indicators; the last weight is the bias."""
    w = np.zeros(len(scale) + 1)
    alpha = np.zeros(len(y))
    values = [scale[r] for r in rows]
    norm = np.array([v @ v for v in values]) + 1.0
    caps = cost * np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y < 0).sum(), 1))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(y)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), caps[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def ratios(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """The log-count ratio of each feature: smoothed share among good rows over that among bad rows."""
    up, down = np.full(size, SMOOTH), np.full(size, SMOOTH)
    for r, label in zip(rows, y, strict=True):
        (up if label > 0 else down)[r] += 1
    return np.log((up / up.sum()) / (down / down.sum()))


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(good | margin), by Newton steps on slightly smoothed targets."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin + 1e-6 * a, g.sum()])
        hess = np.array([[h @ (margin * margin) + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-9]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float, float, float]:
    """(weights of the features, bias, slope, offset)."""
    y = np.where(labels > 0, 1.0, -1.0)
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share)))
    fold, margin = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for f in range(FOLDS):
        learn = [i for i in range(len(y)) if fold[i] != f]
        if len(set(y[learn].tolist())) < 2:
            continue
        own = [rows[i] for i in learn]
        r = ratios(own, y[learn], size)
        w = dual_descent(own, r, y[learn])
        for i in np.flatnonzero(fold == f):
            margin[i] = w[rows[i]] @ r[rows[i]] + w[-1]
    slope, offset = _logistic(margin, y)
    r = ratios(rows, y, size)
    w = dual_descent(rows, r, y)
    return w[:-1] * r, float(w[-1]), max(slope, 1e-3), offset


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, bits: int = BITS) -> tuple[np.ndarray, float, float, float]:
    """The model. `rows` feature lists come to the driver at most, never the texts."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_label"))
    chosen = good.where(crc_mod(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            found = pa.array([features(t.as_py(), bits) for t in p.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("_label"), found], ["doc_id", "label", "features"])

    picked = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("_label").cast("int"))), "doc_id")  # at most `rows` ids
    got = picked.select("doc_id", "_label", "text").dropDuplicates(["doc_id"]).mapInArrow(run, "doc_id long, label int, features array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return fit([], np.zeros(0), bits)
    lists = got.column("features").combine_chunks()
    ends, flat, ids = lists.offsets.to_numpy(), lists.flatten().to_numpy(), got.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return fit([flat[ends[i] : ends[i + 1]] for i in order], got.column("label").to_numpy()[order], bits)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float], bits: int = BITS) -> DataFrame:
    """doc_id and score for every document row."""
    weights, bias, slope, offset = model
    spread = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = spread.value
        for p in parts:
            m = np.array([w[features(t.as_py(), bits)].sum(dtype=np.float64) for t in p.column("text")]) + bias
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(slope * m + offset, -35, 35))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
