"""Embedding near-duplicates: inverted lists with product-quantised residuals, table-lookup distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spectrafold.llm.common import Scratch, tiles
from spectrafold.llm.components import components, spanning

SAMPLE = 16_384
LISTS = 256
PROBES = 8
PARTS = 8
CODES = 256
TILE = 512


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centres, and for each part of the residual a code book; learned from a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int = LISTS, seed: int = 5):
        self.dim = sample.shape[1]
        self.centres = _kmeans(sample, min(lists, max(1, len(sample) // 4)), 8, seed)
        rest = sample - self.centres[self.distances(sample).argmin(axis=1)]
        self.cuts = np.array_split(np.arange(self.dim), min(PARTS, self.dim))
        self.books = [_kmeans(rest[:, c], min(CODES, max(1, len(sample) // 2)), 6, seed) for c in self.cuts]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the coarse centres, without |x|^2."""
        return (self.centres**2).sum(1) - 2 * x @ self.centres.T

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each lies from what its codes say."""
        out = np.stack([((b**2).sum(1) - 2 * rest[:, c] @ b.T).argmin(axis=1) for c, b in zip(self.cuts, self.books)], axis=1)
        back = np.concatenate([b[out[:, k]] for k, b in enumerate(self.books)], axis=1)
        return out.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(axis=1))

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): squared distance of every part of a query's residual to every code."""
        size = max(len(b) for b in self.books)
        out = np.zeros((len(rest), len(self.books), size))
        for k, (c, b) in enumerate(zip(self.cuts, self.books)):
            out[:, k, : len(b)] = np.maximum(0, (rest[:, c] ** 2).sum(1)[:, None] + (b**2).sum(1) - 2 * rest[:, c] @ b.T)
        return out


#: List numbers of vectors of one length; a list's key is the length times this, plus its number.
KEYS = 1 << 16


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one: cosines stay, squares stay finite."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, row numbers) of the vectors of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def _place(quantisers, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, at in _by_length(whole.column("embedding")):
                q, batch = quantisers.value[dim], whole.take(pa.array(at))
                x = _matrix(batch.column("embedding"), dim)
                x /= np.sqrt((x**2).sum(axis=1))[:, None]
                near = np.argsort(q.distances(x), axis=1, kind="stable")[:, :probes]
                code, error = q.codes(x - q.centres[near[:, 0]])
                yield pa.RecordBatch.from_arrays([
                    batch.column("node"), batch.column("weight"), batch.column("embedding"), pa.array(list(near + dim * KEYS), pa.list_(pa.int64())),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["node", "weight", "embedding", "probes", "code", "error"])

    return run


def _search(quantisers, least: float):
    reach = math.sqrt(2 - 2 * least)

    def side(rows, dim: int):
        fields = rows.values
        get = lambda name: fields.field(name)
        x = _matrix(get("embedding"), dim)
        probes = get("probes").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return get("node").to_numpy(zero_copy_only=False), get("weight").to_numpy(zero_copy_only=False), x, probes, fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                home = batch.column("list")[r].as_py()
                q = quantisers.value[home // KEYS]
                ask, ask_w, qx, q_probes, _ = side(batch.column("asking")[r], q.dim)
                own, own_w, mx, m_probes, fields = side(batch.column("members")[r], q.dim)
                qu, mu = (v / np.sqrt((v**2).sum(axis=1))[:, None] for v in (qx, mx))
                code = np.frombuffer(b"".join(fields.field("code").to_pylist()), np.uint8).reshape(len(own), -1)
                error = fields.field("error").to_numpy(zero_copy_only=False)
                tables = q.tables(qu - q.centres[home % KEYS])
                far = np.zeros((len(ask), len(own)))
                for k in range(code.shape[1]):
                    far += tables[:, k, code[:, k]]
                # |q - x| is at least |q - code of x| less the code's own error, so no pair near enough is lost here
                close = np.sqrt(far) <= reach + error[None, :] + 1e-6
                rows, cols = np.nonzero(close & (ask[:, None] != own[None, :]))
                norms = np.sqrt((qx**2).sum(axis=1)), np.sqrt((mx**2).sum(axis=1))
                good = np.zeros(len(rows), bool)
                for at in range(0, len(rows), 1 << 15):
                    i, j = rows[at:at + (1 << 15)], cols[at:at + (1 << 15)]
                    good[at:at + (1 << 15)] = np.einsum("nd,nd->n", qx[i], mx[j]) / (norms[0][i] * norms[1][j]) >= least
                rows, cols = rows[good], cols[good]
                # a pair that the member's own search finds too is counted in the smaller list, or once in this one
                other = q_probes[rows, 0]
                mutual = np.zeros(len(rows), bool)
                for p in range(m_probes.shape[1]):
                    mutual |= m_probes[cols, p] == other
                mine = ~mutual | (home < other) | ((home == other) & (ask[rows] < own[cols]))
                rows, cols = rows[mine], cols[mine]
                if not len(rows):
                    continue
                match = np.zeros((len(ask), len(own)), bool)
                match[rows, cols] = True
                tree_r, tree_c = spanning(match)
                counts_a = np.bincount(rows, weights=own_w[cols], minlength=len(ask)).astype(np.int64)
                counts_b = np.bincount(cols, weights=ask_w[rows], minlength=len(own)).astype(np.int64)
                a, b = np.flatnonzero(counts_a), np.flatnonzero(counts_b)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([ask[tree_r], ask[a], own[b]])),
                    pa.array(np.concatenate([own[tree_c], np.full(len(a) + len(b), -1)]), pa.int64(), mask=np.arange(len(tree_r) + len(a) + len(b)) >= len(tree_r)),
                    pa.array(np.concatenate([np.zeros(len(tree_r), np.int64), counts_a[a], counts_b[b]]))], ["u", "v", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, lists: int = LISTS, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs with cosine >= least that the probes find.

    Equal vectors are one class, linked among themselves; classes are indexed and searched, in tiles of bounded size
    however full a list is. The quantiser is fitted on at most `sample` classes, the first by hash. Vectors that are
    null, zero or hold null or non-finite components, and rows without vec_id, link with nothing; rows without id have no
    component. Vectors of each length have a quantiser of their own and link among themselves. Equal rows count as one
    node. Other columns are ignored; an empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = F.col("embedding")
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding"))
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    classes = scratch.save(
        rows.where("sound").select("vec_id", "embedding").distinct().groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
        .withColumn("dim", F.size("embedding")))
    lengths = [r["dim"] for r in classes.select("dim").distinct().collect()]
    if not lengths:
        lone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return lone.withColumn("kept", F.col("vec_id").isNotNull())
    fitted = {}
    for dim in lengths:  # a few; at most lists + PARTS x CODES centres each
        of_length = classes.where(F.col("dim") == dim).select("embedding", "node", F.xxhash64("node").alias("_hash"))
        # picked by tasks and written: collected at once, every partition would send its own first rows to the driver
        picked = scratch.save(of_length.orderBy("_hash", "node").limit(sample)).toPandas().sort_values(["_hash", "node"])
        x = _scaled(np.array(picked.embedding.tolist(), float))
        fitted[dim] = Quantiser(x / np.sqrt((x**2).sum(axis=1))[:, None], lists)
    quantisers = spark.sparkContext.broadcast(fitted)
    placed = scratch.save(classes.select("node", "weight", "embedding").mapInArrow(
        _place(quantisers, probes), "node long, weight long, embedding array<double>, probes array<long>, code binary, error double"))
    columns = ["node", "weight", "embedding", "probes"]
    members = tiles(placed.withColumn("list", F.col("probes")[0]), "list", "node", TILE, [*columns, "code", "error"]).select("list", F.col("rows").alias("members"))
    asking = tiles(placed.withColumn("list", F.explode("probes")), "list", "node", TILE, columns).select("list", F.col("rows").alias("asking"))
    # tiles hold whole vectors, eight times over, and sizes guessed from files are far too low: no side is broadcast
    found = scratch.save(asking.join(members.hint("merge"), "list").mapInArrow(_search(quantisers, least), "u long, v long, n long"))
    roots = components(found.where("v is not null").select("u", "v"), scratch)
    links = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    named = (
        classes.select("embedding", "node", "weight").join(roots.hint("merge"), "node", "left").join(links.hint("merge"), "node", "left")
        .select("embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    linked = rows.where("sound").join(named.hint("merge"), "embedding").select("vec_id", "n_links", "component_id")
    lone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
