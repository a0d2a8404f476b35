"""Exact similarity join of feature vectors.

Distances to a few pivots bound the distance of two vectors from below (triangle inequality), so vectors within a
radius lie in the same or adjacent cells of pivot distances, and only those meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spectrafold.operators.blocks import join_spread
from spectrafold.session import saved, share_package

# the distances to these make the cell
PIVOTS = 2
# classes of one cell in a tile; a task compares two tiles at a time
TILE = 2_048
# distances that a task computes and links that it returns at once
AT_ONCE = 1 << 18
# relative width by which cells exceed the radius, for the rounding of distances
SLACK = 1e-9
CELL = ["length", "c1", "c2"]


def distance(x: Column | str, y: Column | str) -> Column:
    """Euclidean distance of two arrays of the same length."""
    squares = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def _usable(vector: Column) -> Column:
    broken = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~broken, F.lit(False))


def vector_classes(rows: DataFrame) -> DataFrame:
    """(class_id, vector, n): distinct vectors of (id, vector) with their smallest id and how many ids have them."""
    return rows.distinct().groupBy("vector").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))


def _placed(classes: DataFrame, radius: float) -> DataFrame:
    """Classes with their distances to the pivots of their length and their cell; any choice of pivots gives the same links."""
    classes = classes.withColumn("length", F.size("vector"))
    picked = classes.groupBy("length", F.pmod(F.xxhash64("vector"), F.lit(PIVOTS)).alias("_slot")).agg(
        F.min_by("vector", F.xxhash64(F.lit(3), "vector")).alias("_pivot")
    )
    pivots = picked.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_slot", "_pivot"))).alias("_pivots"))
    rows = join_spread(classes, ["length"], pivots, "class_id")
    rows = rows.withColumn("reach", F.transform("_pivots", lambda p: distance("vector", p["_pivot"])))
    width = radius * (1 + SLACK)
    cell = lambda i: F.floor(F.coalesce(F.get("reach", F.lit(i)), F.lit(0.0)) / width)
    return rows.select("class_id", "vector", "n", "length", cell(0).alias("c1"), cell(1).alias("c2"))


def _tile_pairs(classes: DataFrame, radius: float) -> DataFrame:
    """(x, y, own): tiles of classes that may hold vectors within the radius, each pair of tiles once; own if a tile meets itself.

    A cell with many classes is cut into tiles. A tile meets the tiles of the cells around its own and those of its cell.
    """
    if not radius > 0:
        raise ValueError("radius must be positive; equal vectors are one class")
    share_package(classes.sparkSession)
    placed = saved(_placed(classes.where("class_id IS NOT NULL"), radius))
    sizes = saved(placed.groupBy(*CELL).agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles")))
    tile = F.pmod(F.xxhash64(F.lit(5), "class_id"), F.col("tiles")).cast("int")
    dealt = join_spread(placed, CELL, sizes, "class_id", salts=8).withColumn("tile", tile)
    tiled = saved(dealt.groupBy(*CELL, "tile").agg(F.collect_list(F.struct("class_id", "n", "vector")).alias("rows")))
    # of two opposite steps to another cell, one
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    keys = tiled.select(*CELL, "tile")
    around = keys.select("length", F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("tile").alias("a"), F.explode(steps).alias("s"))
    around = around.select("length", "a1", "a2", "a", (F.col("a1") + F.col("s.i")).alias("c1"), (F.col("a2") + F.col("s.j")).alias("c2"))
    met = around.join(keys, CELL).where("c1 <> a1 OR c2 <> a2 OR a <= tile")
    left = tiled.select("length", F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("tile").alias("a"), F.col("rows").alias("x"))
    pairs = met.join(left, ["length", "a1", "a2", "a"]).join(tiled.withColumnRenamed("rows", "y"), [*CELL, "tile"])
    # a pair of tiles is heavy beside its row, so few pairs are spread, too
    parts = max(classes.sparkSession.sparkContext.defaultParallelism, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.select("x", "y", F.expr("c1 = a1 AND c2 = a2 AND a = tile").alias("own")).repartition(parts, "length", "a1", "a2", "a", *CELL[1:], "tile")
def _arrays(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, counts and vectors of a tile; null entries are NaN, which is near nothing."""
    ids, n, vectors = (rows.field(c) for c in ("class_id", "n", "vector"))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids.to_numpy(zero_copy_only=False), n.to_numpy(), flat.reshape(len(rows), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances) of some rows of x at a time to all of y; squares are added in the order of the entries."""
    step = max(1, AT_ONCE // len(y))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        total = np.zeros((len(part), len(y)))
        for d in range(x.shape[1]):
            gap = part[:, d, None] - y[None, :, d]
            total += np.multiply(gap, gap, out=gap)
        yield at, np.sqrt(total, out=total)


def class_links(classes: DataFrame, radius: float) -> DataFrame:
    """(a, b, n_a, n_b, distance): pairs of different vectors, a < b, whose distance is at most ``radius``.

    Tiles of a cell meet those of the cells around it and their own, so no task holds a whole dense cell.  Vectors of
    different lengths never link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, own in zip(*(batch.column(c) for c in ("x", "y", "own"))):
                (a, n_a, x), (b, n_b, y) = _arrays(left.values), _arrays(right.values)
                kind = left.values.type.field("class_id").type
                for at, gaps in _distances(x, y):
                    i, j = np.nonzero(gaps <= radius)
                    u, v, n_u, n_v, gap = a[i + at], b[j], n_a[i + at], n_b[j], gaps[i, j]
                    ahead = u < v
                    # a tile that meets itself gives each pair twice
                    used = ahead if own.as_py() else u != v
                    ends = [np.where(ahead, one, other)[used] for one, other in ((u, v), (v, u), (n_u, n_v), (n_v, n_u))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ends[0], kind), pa.array(ends[1], kind), *map(pa.array, ends[2:]), pa.array(gap[used])], ["a", "b", "n_a", "n_b", "distance"])

    kind = classes.schema["class_id"].dataType.simpleString()
    return _tile_pairs(classes, radius).mapInArrow(run, f"a {kind}, b {kind}, n_a long, n_b long, distance double")


def _link_counts(classes: DataFrame, radius: float) -> DataFrame:
    """(class_id, _others): rows of other classes within the radius, for classes that have any; pairs are added up where they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, own in zip(*(batch.column(c) for c in ("x", "y", "own"))):
                (a, n_a, x), (b, n_b, y) = _arrays(left.values), _arrays(right.values)
                of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                for at, gaps in _distances(x, y):
                    here = slice(at, at + len(gaps))
                    near = (gaps <= radius) & (a[here, None] != b[None, :])
                    of_a[here] = np.where(near, n_b[None, :], 0).sum(axis=1)
                    of_b += np.where(near, n_a[here, None], 0).sum(axis=0)
                kind = left.values.type.field("class_id").type
                for ids, counts in ((a, of_a),) if own.as_py() else ((a, of_a), (b, of_b)):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[counts > 0], kind), pa.array(counts[counts > 0])], ["class_id", "n"])

    kind = classes.schema["class_id"].dataType.simpleString()
    found = _tile_pairs(classes, radius).mapInArrow(run, f"class_id {kind}, n long")
    return found.groupBy("class_id").agg(F.sum("n").alias("_others"))


def similarity_counts(rows: DataFrame, id_: str, vector: str, radius: float) -> DataFrame:
    """(id, class_id, n_links): the smallest id with the same vector, and how many other ids lie within ``radius``.

    Copies count as links but are never expanded into pairs.  An id given twice with one vector counts once.  Null or
    empty vectors and those with null or non-finite entries are classes of their own without links.
    """
    rows = rows.select(F.col(id_).alias("id"), F.transform(vector, lambda v: v.cast("double") + F.lit(0.0)).alias("vector"))
    usable = saved(rows.where(_usable(F.col("vector"))).distinct())
    classes = saved(vector_classes(usable))
    others = _link_counts(classes, radius)
    counted = classes.join(others, "class_id", "left").select(
        "vector", "class_id", (F.coalesce("_others", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    linked = join_spread(usable, ["vector"], counted, "id", salts=8).select("id", "class_id", "n_links")
    lone = rows.where(~_usable(F.col("vector"))).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")).distinct()
    return linked.unionByName(lone)
