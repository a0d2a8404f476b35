"""Quality scores by Bradley-Terry ranking: preference pairs of labelled documents, logistic loss on feature differences."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_LABELS = 20_000
PAIRS = 60_000
CUT = 0.7
SEGMENT = 1 << 16
BLOCK = 256
WINDOW = 40
_SPACE = re.compile(r"\s+")

#: Byte classes: 0 other sign, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 part of a longer code point.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[9, 10, 13, 32]], _CLASS[[33, 44, 46, 58, 59, 63]] = 4, 5
N_FEATURES = 27


def _segments(text: str) -> Iterator[str]:
    """The text in stretches of about SEGMENT characters, cut at white space where there is some."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text) and (m := _SPACE.search(text, end, end + SEGMENT)):
            end = m.start()
        yield text[at:end]
        at = end


def features(text: str) -> np.ndarray:
    """Fixed-length description of a whole text: shares of byte classes over the text and in its worst blocks,
    repetition of words and of lines over the whole text, word lengths, size. Long texts are read in segments."""
    totals, worst = np.zeros(7), np.zeros(7)
    n_bytes = n_words = distinct = doubled = letters = n_lines = long_words = 0
    least, marks, bars, seen, open_line = 1.0, 0, 0, [], []
    for part in _segments(text):
        raw = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
        blocks = -(-len(raw) // BLOCK)
        shares = np.bincount(np.arange(len(raw)) // BLOCK * 7 + _CLASS[raw], minlength=blocks * 7).reshape(blocks, 7)
        totals += shares.sum(axis=0)
        sizes = shares.sum(axis=1)
        full = shares[sizes >= BLOCK // 4] / sizes[sizes >= BLOCK // 4, None]
        if len(full):
            worst = np.maximum(worst, full.max(axis=0))
        n_bytes += len(raw)
        words = part.split()
        n_words += len(words)
        doubled += sum(map(eq, words, words[1:]))
        letters += len(part) - len(words)
        for at in range(0, len(words), WINDOW):
            window = words[at:at + WINDOW]
            kinds = len(set(window))
            distinct += kinds
            if len(window) == WINDOW:
                least = min(least, kinds / WINDOW)
        marks += part.count("!")
        bars += part.count("|") + part.count("*") + part.count("#") + part.count("&") + part.count("%") + part.count("$")
        first, *others = part.split("\n")
        open_line.append(first)
        if others:  # the last line goes on in the next segment
            lines = ["".join(open_line), *others[:-1]]
            n_lines += len(lines)
            seen.append(np.unique(np.fromiter(map(hash, lines), np.int64, len(lines))))
            open_line = others[-1:]
        long_words += sum(len(w) > 20 for w in words)
    if text:
        n_lines += 1
        seen.append(np.array([hash("".join(open_line))]))
    repeated = n_lines - len(np.unique(np.concatenate(seen))) if seen else 0
    size, count = max(n_bytes, 1), max(n_words, 1)
    part = totals / size
    ttr = distinct / count if n_words else 0.0
    values = [
        *part, *worst, ttr, least, doubled / count, letters / count / 10, long_words / count, marks / count, bars / count,
        repeated / max(n_lines, 1), n_lines / count, math.log1p(n_words) / 10, math.log1p(n_bytes) / 10,
        float(n_words < 20), float(n_words == 0),
    ]
    return np.array(values)


class Model:
    """Weights on standardised features and the score at which the threshold quantile lies."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights - self.cut + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def rank_pairs(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """Bradley-Terry scores from preference pairs (label 1 over label 0), then the quantile that the labels' shares give.

    Each pair adds log(1 + exp(-(s_good - s_bad))) with s linear in the features. Without both labels all scores are
    the cut itself.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(z.shape[1] if len(x) else N_FEATURES)
    if not len(good) or not len(bad):
        return Model(mean, scale, weights, 0.0)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    for _ in range(25):  # Newton steps on the mean loss with a small ridge
        p = 1 / (1 + np.exp(diff @ weights))
        slope = -(diff * p[:, None]).mean(axis=0) + 1e-3 * weights
        bend = (diff * (p * (1 - p))[:, None]).T @ diff / PAIRS + 1e-3 * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, weights, float(np.quantile(z @ weights, len(bad) / len(y))))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Learn from at most max_labels labelled rows, the first by a hash of the id; labels other than 0 and 1 are left out.

    The sample has at most max_labels rows of two numbers, so it is broadcast; its features go to the driver.
    """
    sample = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or "").tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = joined.select("doc_id", "text", "quality").mapInArrow(describe, f"doc_id {kind}, quality int, x array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(rows.x.tolist(), float).reshape(len(rows), N_FEATURES)
    return rank_pairs(x, rows.quality.to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with score (0 to 1, higher: better) and predicted (1 from the threshold quantile, at score 0.7, on).

    Null texts count as empty and are scored like any other; other columns are ignored, repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            got = shared.value.score(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(got), pa.array((got >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double, predicted int")
