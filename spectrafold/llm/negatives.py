"""Hard negatives by the threshold algorithm: per-dimension sorted lists, anchor-signed access, exact integer scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spectrafold.llm.common import Scratch

#: Components of a block of rows, and of the anchors that meet it at once.
CELLS = 1 << 18
FIRST_DEPTH = 32
#: Sums of smaller size are exact in double precision.
EXACT = 2.0**53
LONG = 2**63 - 1
FOUND = "anchor_id long, anchor_row long, window int, score long, id long, row long"


def _clamped(value: int) -> int:
    return max(-LONG, min(LONG, int(value)))


class Lists:
    """A block of rows and, for every dimension, the rows in ascending order of their component."""

    def __init__(self, x: np.ndarray):
        self.size = float(np.abs(x).max()) if x.size else 0.0
        self.exact, self.real = x, x.astype(float) if self.size < EXACT else None
        self.ascending = np.argsort(x, axis=0, kind="stable")

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int] | None], k: int) -> list[list[tuple[int, int]]]:
        """Per window (least, most), both included, or None for all, the first k allowed rows by score down, row up.

        All lists are read from the anchor's side, its largest products first. The rows that a stretch shows first are
        scored by random access; no unseen row scores above the threshold, the sum of the products at the depth reached. The
        search ends once that lies strictly below each window's kth score, or its least one where fewer are known.
        """
        n = len(self.exact)
        used = np.flatnonzero(anchor != 0)
        plain = max(1.0, float(np.abs(anchor).max(initial=0))) * max(1.0, self.size) * len(anchor) < EXACT
        x, pull = (self.real, anchor.astype(float)) if plain else (self.exact, anchor.astype(object))
        down = pull[used] > 0
        seen = np.zeros(n, bool)
        kept: list[list[tuple[int, int]]] = [[] for _ in windows]
        depth, stretch = 0, FIRST_DEPTH
        while True:
            stop = min(n, depth + stretch) if len(used) else n
            shown = np.zeros(n, bool)
            shown[self.ascending[n - stop:n - depth, used[down]]] = True
            shown[self.ascending[depth:stop, used[~down]]] = True
            fresh = np.flatnonzero((shown | (stop == n)) & ~seen)
            seen[fresh] = True
            fresh = fresh[allowed[fresh]]
            scores = x[fresh].astype(pull.dtype, copy=False) @ pull
            scores = scores.astype(np.int64) if plain else np.array([_clamped(s) for s in scores], np.int64)
            for w, window in enumerate(windows):
                fit = np.full(len(fresh), True) if window is None else (scores >= window[0]) & (scores <= window[1])
                rows, marks = fresh[fit], scores[fit]
                first = np.lexsort((rows, -marks))[:k]
                kept[w] = sorted(kept[w] + list(zip(marks[first].tolist(), rows[first].tolist())), key=lambda p: (-p[0], p[1]))[:k]
            if stop == n:
                return kept
            depth, stretch = stop, stretch * 2
            edge = np.where(down, self.ascending[n - depth, used], self.ascending[depth - 1, used])
            threshold = _clamped(x[edge, used].astype(pull.dtype) @ pull[used])
            if all(len(best) == k and threshold < best[-1][0] or window is not None and threshold < window[0] for best, window in zip(kept, windows)):
                return kept


def _integers(column: pa.ListArray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, one row per vector; Python integers where a double holds no such number."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        x = np.floor(flat * scale)
    if (np.abs(x) < EXACT).all():
        return x.astype(np.int64).reshape(-1, dim)
    return np.array([int(v) if abs(v) < np.inf else int(f) * scale for v, f in zip(x, flat)], object).reshape(-1, dim)


def _search(k: int, scale: int, low: int, high: int, same: bool):
    """(block, members, anchors) to FOUND: each anchor's best rows of the block, of its own label and in one window if
    `same`, else of other labels, per positive score p of the anchor in the window low * p <= 100 * score <= high * p."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = None
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                if home != (block := batch.column("block")[r].as_py()):  # rows of a block follow each other
                    rows = batch.column("members")[r].values
                    ids, own, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row", "label"))
                    order = np.lexsort((own, ids))
                    ids, own, labels = ids[order], own[order], labels[order]
                    lists = Lists(_integers(rows.field("embedding"), dim, scale)[order])
                    home = block
                asking = batch.column("anchors")[r].values
                vectors = _integers(asking.field("embedding"), dim, scale)
                asked = zip(*(asking.field(c).to_pylist() for c in ("vec_id", "row", "label", "windows")), vectors)
                out = []
                for anchor_id, anchor_row, label, windows, vector in asked:
                    allowed = (labels == label) & ~((ids == anchor_id) & (own == anchor_row)) if same else labels != label
                    bounds = [None] if same else [(-(-low * w["score"] // 100), high * w["score"] // 100) for w in windows]
                    spots = [w for w, b in enumerate(bounds) if b is None or b[0] <= b[1]]
                    if allowed.any() and spots:
                        for w, best in zip(spots, lists.best(vector, allowed, [bounds[w] for w in spots], k)):
                            window = 0 if same else windows[w]["window"]
                            out += [(anchor_id, anchor_row, window, s, int(ids[i]), int(own[i])) for s, i in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _tiled(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(key, dim, tile, name): the rows of every key, dealt by hash over tiles of about CELLS components."""
    sizes = df.groupBy("key", "dim").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") / CELLS).alias("_tiles"))
    placed = df.join(sizes, ["key", "dim"]).withColumn("tile", F.pmod(F.xxhash64(F.lit(7), "vec_id", "row"), F.col("_tiles")))
    return placed.groupBy("key", "dim", "tile").agg(F.collect_list(F.struct(*columns)).alias(name))


def _met(members: DataFrame, anchors: DataFrame, scratch: Scratch, search) -> DataFrame:
    """Every tile of anchors before every tile of members with its key; both have key, dim, vec_id, row, label, embedding."""
    blocks = scratch.save(_tiled(members, "members", ["vec_id", "row", "label", "embedding"]))
    spans = blocks.groupBy("key", "dim").agg(F.max("tile").alias("last"))
    asking = _tiled(anchors, "anchors", ["vec_id", "row", "label", "embedding", "windows"]).drop("tile")
    asking = asking.join(spans, ["key", "dim"]).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    pairs = asking.join(blocks, ["key", "dim", "tile"]).select(F.to_json(F.struct("key", "dim", "tile")).alias("block"), "dim", "members", "anchors")
    return scratch.save(pairs.mapInArrow(search, FOUND))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding).

    Components become floor(scale * x), x in double precision; a row's score is its inner product with the anchor, an
    integer, clamped to 64 bits. Higher scores come first, ties go by vec_id. An anchor's positives are its first
    `positives` other rows of its label; per positive score p, the first `negatives` rows of other labels with
    low * p <= 100 * score <= high * p are returned, ranked from 1. Only rows of the anchor's length can be compared.
    Rows with a null id, label or vector, or a null or non-finite component, take no part; equal rows count once; rows
    that differ but share an id are rows of their own, ties among them by a hash of the row. Anchors without positives or
    fitting negatives, and an empty table, give no rows; further columns are ignored.

    Rows are dealt by hash into blocks of bounded size, with lists of their own; an anchor meets the blocks of its label
    for positives and all blocks for negatives, and the blocks' best are ranked per window.
    """
    scratch = Scratch(vectors.sparkSession)
    v = F.col("embedding")
    sound = F.coalesce(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    rows = vectors.select("vec_id", "label", v.cast("array<double>").alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound & (F.size("embedding") > 0)).distinct()
    rows = scratch.save(rows.withColumn("row", F.xxhash64("vec_id", "label", "embedding")).withColumn("dim", F.size("embedding")))
    anchors = rows.where("asks")
    by_label = F.col("label").cast("string").alias("key")
    found = _met(
        rows.select("*", by_label), anchors.select("*", by_label, F.lit(None).cast("array<struct<window:int,score:long>>").alias("windows")),
        scratch, _search(positives, scale, low, high, True))
    near = scratch.save(_first(found, ["anchor_id", "anchor_row"], positives).select(
        "anchor_id", "anchor_row", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = near.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row")).agg(
        F.collect_list(F.struct("window", F.col("positive_score").alias("score"))).alias("windows"))
    everywhere = F.lit("").alias("key")
    found = _met(
        rows.select("*", everywhere), anchors.join(windows, ["vec_id", "row"]).select("*", everywhere), scratch, _search(negatives, scale, low, high, False))
    best = _first(found, ["anchor_id", "anchor_row", "window"], negatives)
    return best.join(near, ["anchor_id", "anchor_row", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same for embeddings, with the labels moved and the anchors of the query, by comparing every anchor with every row.
NEGATIVES_SQL = """
WITH sound AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""
