"""Document fingerprints: threshold-scaled sketches of shingle hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

WORDS = 5
HASH_BITS = 48
#: Share of the hashes' range below which fingerprints of documents keep a hash, in every text.
FRACTION = 0.5
SEGMENT_WORDS = 1 << 16
FLUSH = 16 << 20

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, repeats included, in blocks; shorter sequences are one shingle, no words none."""
    raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
    digest = xxhash.xxh64_intdigest
    found = WORD.finditer(raw)
    held: list[bytes] = []
    first = True
    while True:
        new = [m.group() for _, m in zip(range(SEGMENT_WORDS), found)]
        tokens = held + new
        if len(tokens) < words:
            if first and tokens:
                yield np.array([digest(b" ".join(tokens), seed)], np.uint64)
            return
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        joined = b" ".join(tokens)
        stops = ends[words - 1:].tolist()
        starts = [0, *(ends[: len(ends) - words] + 1).tolist()]
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))
        first = False
        if len(new) < SEGMENT_WORDS:
            return
        held = tokens[len(tokens) - words + 1:]


def sketch(text: str, fraction: float = 1.0) -> np.ndarray:
    """Sorted distinct hashes of all shingles that lie below `fraction` of the hashes' range.

    Which hashes are kept depends on them alone, so sketches of one fraction merge by union, and the share of one that
    another holds estimates the containment of its shingles, however unequal the documents are; at 1 it is exact.
    """
    limit = np.uint64(int(fraction * 2**HASH_BITS))
    kept = [np.unique(hashes[hashes < limit]) for hashes in (block >> np.uint64(64 - HASH_BITS) for block in shingle_hashes(text, WORDS))]
    return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)


def text_of(hashes: np.ndarray) -> str:
    """The sketch as hex, twelve digits a hash."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller sketch that the larger one holds; two empty sketches are alike, an empty and another not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def _ranges(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) with `part`, a range of ids, and a copy of each range's first document, marked `guard`,
    in the range before it; the first of all goes to the last range."""
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    edges = np.array(bounds)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.fillna(-np.inf).to_numpy(float), side="left").astype(np.int32))

    placed = docs.withColumn("part", part_of(F.col("doc_id").cast("double")))
    firsts = placed.groupBy("part").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null")).orderBy("part").collect()
    spark = docs.sparkSession
    before = [(None if row["null"] else row["first"], firsts[k - 1]["part"]) for k, row in enumerate(firsts)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    guards = spark.createDataFrame(before, f"first {kind}, before int")  # one row per range
    at = placed.join(F.broadcast(guards), placed["doc_id"].eqNullSafe(guards["first"]), "left")
    places = F.array_compact(F.array(
        F.struct("part", F.lit(0).alias("guard")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(1).alias("guard")))))
    return at.select("doc_id", "text", F.explode(places).alias("place")).select("place.part", "place.guard", "doc_id", "text")


def _compare(batches: Iterator[pa.RecordBatch], fraction: float) -> Iterator[pa.RecordBatch]:
    last = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

        rows, size = [], 0
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            for part, guard, doc_id, text in zip(*(piece.column(c).to_pylist() for c in ("part", "guard", "doc_id", "text"))):
                now = (part, guard, doc_id, text or "", sketch(text or "", fraction))
                if last is not None and last[0] == part and not last[1]:
                    old, own = last[3], last[4]
                    cut = len(old) // 4
                    edited = old[: len(old) - cut] + now[3][:cut]
                    other = sketch(edited, fraction)
                    rows.append((last[2], len(old), hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(other), likeness(own, other), likeness(own, now[4])))
                    size += len(rows[-1][3]) + len(rows[-1][4])
                    if size > FLUSH:
                        yield table(rows)
                        rows, size = [], 0
                last = now
        yield table(rows)


def compare_with_edits(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses to the edited and the next text.

    The next document is the one with the next id; after the last comes the first. Null ids sort first, rows that
    share an id follow each other by text, null texts count as empty. Short texts may keep no hash; their likeness is 1 to each other and 0 to texts that do. Ranges of ids are sorted each on its own, and a
    range holds a copy of the first document after it, so no task sees more than a range. An empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _ranges(docs.select("doc_id", "text"), parts)
    order = placed.repartition(parts, "part").sortWithinPartitions("part", "guard", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return order.mapInArrow(
        partial(_compare, fraction=fraction), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
