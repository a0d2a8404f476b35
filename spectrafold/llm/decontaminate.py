"""Benchmark decontamination by Wu-Manber search: block shift tables, suffix-hash buckets, direct comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from spectrafold.llm.common import Scratch

WORDS = 10
#: Bytes that belong to words, after lower-casing.
LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Pairs of window and item that one pass over the documents searches for, and their bytes; more take more passes.
GROUP = 100_000
GROUP_BYTES = 16 << 20
TABLE_BITS = 20
BUFFER = 4 << 20
LANE = 512
ODD = np.uint64(0x9E3779B97F4A7C15)

_KEEP = bytes.maketrans(
    bytes(range(256)), bytes(c + 32 if 65 <= c <= 90 else c if c in LETTERS else 32 for c in range(256)))


def normal_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, other ASCII than digits and letters parts them."""
    return text.translate(_KEEP).split()


def _loads(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of the buffer as one number; no copy. The buffer ends with eight spare bytes."""
    return np.ndarray(len(buffer) - 8, "<u8", buffer, strides=(1,))


class Search:
    """Shift and bucket tables of patterns whose lengths differ by a factor below two."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.reach = min(map(len, patterns))
        self.block = min(16, (self.reach + 1) // 2)
        bits = min(TABLE_BITS, 8 * self.block)
        self.drop = np.uint64(64 - bits)
        heads = np.frombuffer(b"".join(p[: self.reach] for p in patterns) + bytes(16), np.uint8)
        starts = np.arange(len(patterns)) * self.reach
        self.shift = np.full(1 << bits, self.reach - self.block + 1, np.uint8 if self.reach < 256 else np.uint16 if self.reach < 1 << 16 else np.int64)
        loads = _loads(heads)
        for back in range(self.reach - self.block, -1, -1):  # the nearest block to the end is written last
            self.shift[self.cells(loads, starts + self.reach - self.block - back)] = back
        suffix = self.hashes(loads, starts + self.reach - self.block)
        self.order = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.order]
        self.prefixes = self.prefix(loads, starts)[self.order]

    def hashes(self, loads: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One number per block that begins at `at`: of its first and its last eight bytes."""
        if self.block < 8:
            return (loads[at] << np.uint64(8 * (8 - self.block))) * ODD
        return (loads[at] ^ (loads[at + self.block - 8] * ODD)) * ODD

    def cells(self, loads: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.hashes(loads, at) >> self.drop).astype(np.int64)

    def prefix(self, loads: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = min(8, self.reach)
        return loads[at] << np.uint64(8 * (8 - size))

    def find(self, raw: bytes, buffer: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, pattern) of all occurrences in raw. Lanes, stretches of the text, move in step: each looks up the
        block that ends its window, moves by the table's shift, and where that is zero tests the block's bucket."""
        last = len(raw) - self.reach  # of the window's beginnings
        loads, gap = _loads(buffer), self.reach - self.block
        at = np.arange(0, max(0, last + 1), LANE)
        ends = np.minimum(at + LANE, last + 1)
        while len(at):
            shift = self.shift[self.cells(loads, at + gap)].astype(np.int64)
            here = at[shift == 0]
            if len(here):
                suffix = self.hashes(loads, here + gap)
                low, high = np.searchsorted(self.suffixes, suffix, "left"), np.searchsorted(self.suffixes, suffix, "right")
                sizes = high - low
                spot = np.repeat(here, sizes)
                slot = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                good = self.prefixes[slot] == self.prefix(loads, spot)
                for position, n in zip(spot[good].tolist(), self.order[slot[good]].tolist()):
                    if raw.startswith(self.patterns[n], position):
                        yield position, n
            at = at + np.maximum(shift, 1)
            going = at < ends
            at, ends = at[going], ends[going]


class Windows:
    """The searches for one group of windows, one per class of lengths, and the items that have each window."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        self.items: dict[bytes, list[str]] = {}
        for window, item in pairs:
            self.items.setdefault(b" " + window + b" ", []).append(item)
        classes: dict[int, list[bytes]] = {}
        for pattern in self.items:
            classes.setdefault(len(pattern).bit_length(), []).append(pattern)
        self.searches = [Search(patterns) for _, patterns in sorted(classes.items())]

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Per document, given as words: the stretches (first, end) of words that occurrences cover, and the items."""
        lines = [b" " + b" ".join(words) + b" \n" for words in texts]
        raw = b"".join(lines)
        buffer = np.frombuffer(raw + bytes(16), np.uint8)
        starts = np.cumsum([0, *map(len, lines)])
        hits: dict[int, list[tuple[int, bytes]]] = {}
        for search in self.searches:
            for position, n in search.find(raw, buffer):
                hits.setdefault(int(np.searchsorted(starts, position, "right")) - 1, []).append((position, search.patterns[n]))
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
        for doc, found in hits.items():
            spaces = np.flatnonzero(buffer[starts[doc]:starts[doc + 1]] == 32)
            first = np.searchsorted(spaces, np.array([p for p, _ in found]) - starts[doc])
            spans = sorted(zip(first.tolist(), (first + [p.count(b" ") - 1 for _, p in found]).tolist()))
            out[doc] = merged(spans), {item for _, p in found for item in self.items[p]}
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for first, end in spans:
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((first, end))
    return out


def _windows(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            words = normal_words(text)
            for at in range(0, max(1, len(words) - WORDS + 1), 4096):
                stop = min(at + 4096, max(1, len(words) - WORDS + 1)) if words else 0
                found = {b" ".join(words[k:k + WORDS]) for k in range(at, stop)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([item] * len(found), pa.string())], ["words", "item"])


def _scan(windows, keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = windows.value
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

        def results(ids: list, texts: list[list[bytes]], digests: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
            found = search.scan(texts)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, kind), pa.array(digests, pa.binary()), pa.array(list(map(len, texts)), pa.int64()),
                pa.array([[{"first": a, "end": b} for a, b in spans] for spans, _ in found], span),
                pa.array([sorted(items) for _, items in found], pa.list_(pa.string()))], ["doc_id", "digest", "n_words", "spans", "items"])

        for batch in batches:
            ids, texts, digests, size = [], [], [], 0
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py() or b""
                ids.append(batch.column("doc_id")[k].as_py())
                texts.append(normal_words(text))
                digests.append(hashlib.sha256(text).digest() if keyed else b"")
                size += len(text)
                if size > BUFFER:
                    yield results(ids, texts, digests, batch.schema.field("doc_id").type)
                    ids, texts, digests, size = [], [], [], 0
            if ids:
                yield results(ids, texts, digests, batch.schema.field("doc_id").type)

    return run


def _groups(benchmark: DataFrame, scratch: Scratch, group: int, group_bytes: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(words, item, bucket) of all windows, dealt by hash, and ranges of buckets that keep both bounds."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    pairs = items.where("text is not null").mapInArrow(_windows, "words binary, item string").distinct()
    pairs = scratch.save(pairs.withColumn("bucket", F.pmod(F.xxhash64("words", "item"), F.lit(1 << 16)).cast("int")))
    counts = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("words") + F.length("item")).alias("size"))
    so_far = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)  # at most 65,536 rows
    part = F.greatest(F.floor((F.sum("n").over(so_far) - 1) / group), F.floor((F.sum("size").over(so_far) - 1) / group_bytes))
    parts = counts.select("bucket", part.alias("part")).groupBy("part").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    return pairs, [(r["low"], r["high"]) for r in parts.orderBy("part").collect()]


def occurrences(docs: DataFrame, benchmark: DataFrame, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: how many words it has, the stretches (first, end) of words that
    occurrences of benchmark windows cover, disjoint and ascending, and the sorted ids, as text, of their items.

    Words are runs of digits, letters and all that is not ASCII, A-Z lower-cased. A window is ten consecutive words of an
    item, or all of an item with fewer. Null texts have no words; items without words have no window; items without id are
    named by the empty text; items that share an id are one. Equal documents are found each; an empty benchmark leaves
    all documents clean; an empty table gives no rows; other columns are ignored. Texts of any length are searched whole.

    Documents are read once for every `group` windows or `group_bytes`, so what is broadcast is bounded whatever the benchmark's
    size, and only documents with occurrences are shuffled, where there is more than one pass.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    pairs, ranges = _groups(benchmark, scratch, group, group_bytes)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, n_words long, spans array<struct<first:long,end:long>>, items array<string>"
    passes = []
    for low, high in ranges or [(0, -1)]:
        rows = pairs.where(F.col("bucket").between(low, high)).select("words", "item").collect()  # bounded by group and group_bytes
        windows = spark.sparkContext.broadcast(Windows([(bytes(r["words"]), r["item"]) for r in rows]))
        passes.append(texts.mapInArrow(_scan(windows, len(ranges) > 1), schema))
    if len(passes) == 1:
        return passes[0].drop("digest")
    passes = [scratch.save(p if k == 0 else p.where("size(items) > 0")) for k, p in enumerate(passes)]
    first, hit = passes[0], passes[0].where("size(items) > 0")
    for later in passes[1:]:
        hit = hit.union(later)
    start = F.array().cast("array<struct<first:long,end:long>>")
    touches = lambda done, s: (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["end"])
    joined = F.aggregate(F.array_sort(F.flatten(F.collect_set("spans"))), start, lambda done, s: F.when(
        touches(done, s), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))))
    merge = hit.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("sign")).agg(
        joined.alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("all_items"))
    both = first.join(merge, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sign")), "left")
    return both.select("doc_id", "n_words", F.coalesce("all_spans", "spans").alias("spans"), F.coalesce("all_items", "items").alias("items"))


#: The same by joining sequences of words of documents with windows, per length that windows have.
OCCURRENCES_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT rid, k, size, array_to_string(w[k:k + size - 1], ' ') AS words
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT rid, k, s.size, item FROM spots s JOIN windows v ON s.size = v.size AND s.words = v.words),
hits AS (
  SELECT rid, count(DISTINCT n) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS n FROM found) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""
