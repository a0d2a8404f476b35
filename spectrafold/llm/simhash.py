"""SimHash near-duplicates: tiled exact comparison, tiles chosen by population counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spectrafold.llm.common import Scratch, tiles
from spectrafold.llm.components import components, spanning
from spectrafold.llm.sketches import shingle_hashes

RADIUS = 2
TILE = 1024
QUARTERS = 4
_BITS_AT_ONCE = 1 << 14


def simhash(text: str, words: int) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes, repeats included."""
    ones, n = np.zeros(64, np.int64), 0
    for block in shingle_hashes(text, words):
        n += len(block)
        for at in range(0, len(block), _BITS_AT_ONCE):
            part = block[at:at + _BITS_AT_ONCE].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fingerprints of whole texts; null texts and texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t or "", words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _cell(fp: Column) -> Column:
    """Population counts of the four 16-bit quarters as one number, 32 to a place."""
    cell = F.lit(0)
    for k in range(QUARTERS):
        cell = cell * 32 + F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))
    return cell.cast("int")


def _steps(radius: int) -> list[int]:
    """Differences of cell numbers whose population counts differ by the radius at most, one of each opposite pair.

    Two fingerprints differ in at least as many bits as the population counts of their quarters do in sum.
    """
    near = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return sorted({sum(x * 32 ** (QUARTERS - 1 - k) for k, x in enumerate(d)) for d in near if d >= (0,) * QUARTERS})


def linked(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): differing fingerprints within the radius, enough of the links to connect what all links connect.

    classes has distinct `fp`. Every tile meets the tiles of the cells around its own, nothing else; a pair of tiles
    gives no more rows than it has fingerprints, twice.
    """
    tiled = tiles(classes.select("fp", _cell(F.col("fp")).alias("cell")), "cell", "fp", TILE, ["fp"])
    tiled = tiled.select("cell", "tile", F.col("rows.fp").alias("fps"))
    around = tiled.select(
        F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a"), F.col("cell").alias("cell_a"),
        F.explode(F.array(*[F.lit(s) for s in _steps(radius)])).alias("step")).withColumn("cell", F.col("cell_a") + F.col("step"))
    pairs = around.join(tiled, "cell").where("step <> 0 or tile_a <= tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for left, right in zip(batch.column("fps_a"), batch.column("fps")):
                a, b = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
                match = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
                if match.any():
                    rows, cols = spanning(match)
                    us.append(a[rows].view(np.int64))
                    vs.append(b[cols].view(np.int64))
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return pairs.select("fps_a", "fps").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of fingerprints reach.

    Documents with one fingerprint are one class; only classes are compared. Null ids get a component by their
    fingerprint and are never a component's id unless it has no other. Repeated rows stay; other columns of docs are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(fingerprints(docs, words))
    classes = scratch.save(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(linked(classes, radius), scratch)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted)
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group: all columns of the rows whose id is their group's.

    Of rows that repeat the id, the first by text stays; rows without an id stay.
    """
    return one_of_each(docs, near_duplicates(docs, words, radius).where("doc_id = component_id").select("doc_id").distinct())


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs with an id of groups, one for each id, the first by text; and the rows without an id.

    Ids alone say which rows go and which repeat; only rows that repeat a kept id are compared. The lists of both are
    written, so that Spark knows their size and moves no text to meet a short one.
    """
    scratch = Scratch(docs.sparkSession)
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    marked = ids.join(groups.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left")
    apart = scratch.save(marked.where("kept IS NULL OR n > 1").select("doc_id", "kept"))
    repeated = scratch.save(apart.where("kept").select("doc_id"))
    once = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("row")).select("row.*")
    return docs.join(apart, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
