"""Near-duplicate documents by the exact similarity of their shingle sets; MinHash bands say which sets to compare."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spectrafold.llm.common import Scratch
from spectrafold.llm.components import components
from spectrafold.llm.simhash import one_of_each
from spectrafold.llm.sketches import shingle_hashes

WORDS = 5
LEAST = 0.8
#: Sets of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: all but 7 in a million at 0.8, 1 in 100 at 0.2.
BANDS, ROWS = 30, 5
TILE = 128
_AT_ONCE = 1 << 10

_factors, _mix = (np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    blocks = [np.unique(block) for block in shingle_hashes(text, words)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def set_number(hashes: np.ndarray) -> int:
    """Signed 64-bit number of a set; equal sets have one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band, made of the least values that the band's ROWS hash functions take on the set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, (hashes[at:at + _AT_ONCE, None] * _factors).min(axis=0), out=least)
    mixed = (least ^ least >> np.uint64(32)) * _mix
    return mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(own: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets have a Jaccard similarity of `least` or more with `own`, a sorted set."""
    sizes, n = np.array([len(s) for s in sets]), len(own)
    out = (sizes == 0) & (n == 0)
    for i in np.flatnonzero(np.minimum(sizes, n) / np.maximum(np.maximum(sizes, n), 1) >= least):
        common = len(np.intersect1d(own, sets[i], assume_unique=True))
        out[i] = common / (n + sizes[i] - common) >= least
    return out


def forest(sets: list[np.ndarray], least: float, groups: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Pairs of sets with Jaccard similarity of `least` or more that connect all that such pairs connect.

    A set meets only those that none before it has found. Sets of one group count as connected and never meet.
    """
    group = np.arange(len(sets)) if groups is None else np.array(groups, np.int64)
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    unseen, us, vs = np.ones(len(sets), bool), [], []
    for seed in range(len(sets)):
        front = [seed] if unseen[seed] else []
        unseen[seed] = False
        while front:
            x = front.pop()
            kin = np.flatnonzero(unseen & (group == group[x]))
            unseen[kin] = False
            front += kin.tolist()
            rest = unseen & (sizes >= least * sizes[x]) & (sizes * least <= sizes[x])
            if not rest.any():
                continue
            own = np.zeros(len(names), bool)
            own[flat[begin[x]:begin[x] + sizes[x]]] = True
            common = np.bincount(of[own[flat]], minlength=len(sets))
            got = np.flatnonzero(rest & (common / np.maximum(sizes + sizes[x] - common, 1) >= least))
            unseen[got] = False
            us += [x] * len(got)
            vs += got.tolist()
            front += got.tolist()
    return us, vs


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "", words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([set_number(s) for s in sets], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "", words) for t in batch.column("text").to_pylist()]
            own = pa.array([set_number(s) == node for s, node in zip(sets, batch.column("node").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"]).filter(own)

    return run


def _pairs(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us + none)), pa.array(np.concatenate(vs + none))], ["u", "v"])


def _star(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for v, own, rows in zip(*(batch.column(c).to_pylist() for c in ("v", "own", "rows"))):
                good = alike(np.frombuffer(own, np.uint64), [np.frombuffer(row["hashes"], np.uint64) for row in rows], least)
                us.append(np.array([row["node"] for row in rows], np.int64)[good])
                vs.append(np.full(int(good.sum()), v, np.int64))
            yield _pairs(us, vs)

    return run


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for met in batch.column("met"):
                rows = met.as_py()
                i, j = forest([np.frombuffer(row["hashes"], np.uint64) for row in rows], least, [row["root"] for row in rows])
                node = np.array([row["node"] for row in rows], np.int64)
                us.append(node[i])
                vs.append(node[j])
            yield _pairs(us, vs)

    return run


def _tile(count: str):
    """Tile of a node among the tiles of some TILE rows that hold `count` rows."""
    return F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.ceil(F.col(count) / TILE))


def representatives(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs with one document of each group: all columns of the rows whose id is the smallest that links reach.

    Links are pairs of texts whose sets of word shingles have a Jaccard similarity of `least` or more, computed on the
    whole sets; texts without words are alike. Equal sets are one class. Classes of a band are a bucket. Every class
    first meets the least class of each of its buckets, in tiles. Buckets that these links leave in more than one group
    then meet whole, in pairs of tiles, where classes of different groups are compared; equal buckets do so once. So a
    task holds two tiles at most, and the work of a bucket does not depend on what other buckets chain to it.
    Of rows that repeat an id, the first by text stays; rows without an id stay and link nothing; an empty table gives no
    rows; other columns are kept.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.where(F.col("doc_id").isNotNull())
    found = scratch.save(named.select("doc_id", "text").mapInArrow(_describe(words), f"doc_id {kind}, node long, bands array<long>"))
    classes = scratch.save(found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    scratch.drop(found)
    keys = classes.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("band", "v")
    members = scratch.save(keys.join(shared, "band"))
    # written, so that Spark knows whether the list is short enough to leave the texts where they are
    suspects = scratch.save(classes.join(members.select("node").distinct(), "node").select("doc_id", "node"))
    sets = scratch.save(named.select("doc_id", "text").join(suspects, "doc_id").select("text", "node").mapInArrow(
        _sets(words), "node long, hashes binary").dropDuplicates(["node"]))

    stars = members.where("node <> v").select("node", "v").distinct()
    dealt = stars.join(stars.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v").withColumn("tile", _tile("n"))
    rows = dealt.join(sets, "node").groupBy("v", "tile").agg(F.collect_list(F.struct("node", "hashes")).alias("rows"))
    near = rows.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("own")), "v").select("v", "own", "rows")
    grouped = components(near.mapInArrow(_star(least), "u long, v long"), scratch)

    rooted = scratch.save(members.join(grouped, "node", "left").select("node", "band", F.coalesce("root", "node").alias("root")))
    split = rooted.groupBy("band").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("sign")).where("lo <> hi")
    split = split.groupBy("lo", "hi", "n", "sign").agg(F.min("band").alias("band"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / TILE) - 1))
    met = (
        rooted.join(split, "band").withColumn("tile", _tile("n")).join(sets, "node").withColumn("other", other).where(f"other <> tile or n <= {TILE}")
        .groupBy("band", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
        .agg(F.collect_list(F.struct("node", "root", "hashes")).alias("met")))
    more = met.select("met").mapInArrow(_compare(least), "u long, v long")
    roots = components(grouped.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), scratch)
    for done in (members, suspects, sets, rooted):
        scratch.drop(done)
    firsts = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("doc_id").alias("doc_id"))
    return one_of_each(docs, firsts.select("doc_id").distinct())
