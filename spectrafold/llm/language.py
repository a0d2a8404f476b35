"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 16
ORDERS = (2, 3)
PIECE = 1 << 19
MAX_LANGUAGES = 256
UNKNOWN = "und"

_fold: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    global _fold
    if _fold is None:
        _fold = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                _fold[c] = ord(chr(c).lower()[0])
    return _fold


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Groups of text pieces of PIECE characters in all, with their row and the number of n-gram starts they own.

    A long text is cut into pieces that overlap by the longest n-gram less one, so that every n-gram is met once.
    """
    more = max(ORDERS) - 1
    parts, rows, owned, total = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            piece = text[at:at + PIECE + more]
            parts.append(piece)
            rows.append(row)
            owned.append(min(PIECE, len(text) - at))
            total += len(piece)
            if total >= PIECE:
                yield parts, rows, owned
                parts, rows, owned, total = [], [], [], 0
    if parts:
        yield parts, rows, owned


def hashed_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the text, bucket) of every n-gram that holds a letter, block by block."""
    table = _fold_table()
    for parts, rows, owned in _pieces(texts):
        points = table[np.frombuffer(" ".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.array([len(p) + 1 for p in parts])
        piece = np.repeat(np.arange(len(parts)), lengths)
        local = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        starts = local < np.array(owned)[piece]
        row_of = np.array(rows)[piece]
        code = points.copy()
        letter = points != 32
        for n in range(2, max(ORDERS) + 1):
            code = code[:-1] * np.uint32(0x01000193) + points[n - 1:]
            letter = letter[:-1] | (points[n - 1:] != 32)
            if n in ORDERS:
                # the space after a text, the last one too, is its end; a gram that goes on into the next text is none
                good = letter & starts[: len(code)] & (piece[n - 1:] == piece[: len(code)])
                mixed = code[good]
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
                yield row_of[: len(code)][good], ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    n_docs: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        names = sorted(set(langs))
        at = {name: k for k, name in enumerate(names)}
        lang_of = np.array([at[x] for x in langs])
        both = np.zeros(len(names) << BITS, np.int64)
        for rows, buckets in hashed_grams(texts):
            both += np.bincount((lang_of[rows] << BITS) + buckets, minlength=len(both))
        for name in names:
            counts[name] = counts.get(name, 0) + both[at[name] << BITS:(at[name] + 1) << BITS]
            n_docs[name] = n_docs.get(name, 0) + langs.count(name)
        if len(counts) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    for name, row in counts.items():
        used = np.flatnonzero(row)
        yield pa.RecordBatch.from_pydict({
            "lang": [name] * (len(used) + 1), "bucket": np.append(used, -1), "n": np.append(row[used], n_docs[name]).astype(np.int64)})


class Model:
    """Log-probabilities (languages x buckets), log-priors and the names, sorted."""

    def __init__(self, names: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.names, self.log_prob, self.prior = names, log_prob, prior


def fit(train: DataFrame) -> Model:
    """Counts of all training rows with a language, summed by Spark; the driver gets languages x buckets at most."""
    rows = (
        train.where(F.col("lang").isNotNull()).select("text", "lang")
        .mapInArrow(_count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    names = sorted(rows.lang.unique())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts, docs = np.zeros((len(names), 1 << BITS)), np.zeros(len(names))
    for k, name in enumerate(names):
        own = rows[rows.lang == name]
        counts[k, own.bucket[own.bucket >= 0]] = own.n[own.bucket >= 0]
        docs[k] = own.n[own.bucket < 0].sum()
    smooth = counts + 0.5
    log_prob = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32) if names else counts
    return Model(names, log_prob, np.log(docs / docs.sum()) if names else docs)


def _guess(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    total = np.zeros((len(model.names), len(texts)))
    grams = np.zeros(len(texts), np.int64)
    for rows, buckets in hashed_grams(texts):
        grams += np.bincount(rows, minlength=len(texts))
        for k in range(len(model.names)):
            total[k] += np.bincount(rows, weights=model.log_prob[k][buckets], minlength=len(texts))
    if not model.names or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total += model.prior[:, None]
    best, known = total.argmax(axis=0), grams > 0
    sure = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
    return [model.names[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, sure, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with lang_pred and score, the posterior probability of the language predicted.

    Texts that are null or have no letter, and all texts when no language was learned, get `und` and score 0. Equal
    posteriors go to the name that sorts first. Other columns of docs are ignored; repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, sure = _guess(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def with_known_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a posterior of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, sure = _guess(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, sure)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
