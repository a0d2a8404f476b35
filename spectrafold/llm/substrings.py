"""Removal of byte strings that also start earlier: pieces dealt by content to shards, suffix-sorted there.

Every 100-byte string picks one anchor inside itself, the 24 bytes with the least hash. Strings that follow each other
and share an anchor form a piece; equal strings have equal anchors, so the pieces of one anchor meet in one shard, and
nothing else has to. What stands earliest is then found among the sorted suffixes of the shard's pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from spectrafold.llm.suffixes import CAP, sorted_suffixes

LENGTH = CAP
GRAM = 24
WINDOW = LENGTH - GRAM + 1
REACH = (LENGTH - GRAM) // 2  # a string has this many bytes before its anchor, or after it
SEGMENT = 1 << 20
POS_BITS = 22
FLUSH = 12 << 20
SHARDS_PER_PARTITION = 4
NULL_ID = -(1 << 63)

_ODD = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SEGMENT * 2)
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def anchors(raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor hash, anchor) of every piece of raw, whose bytes belong to `owner`; no piece mixes owners."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = h >> np.uint64(POS_BITS) << np.uint64(POS_BITS) | np.arange(len(h), dtype=np.uint64)
    windows = n - LENGTH + 1
    padded = np.full(-(-len(h) // WINDOW) * WINDOW + WINDOW, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, WINDOW)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(since[:windows], upto[WINDOW - 1:WINDOW - 1 + windows])
    at = np.flatnonzero(owner[:windows] == owner[LENGTH - 1:])
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    new = np.r_[True, (np.diff(at) != 1) | (least[at][1:] != least[at][:-1]) | (owner[at][1:] != owner[at][:-1])]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:] - 1, len(at) - 1]
    chosen = least[at[head]].astype(np.int64)
    return at[head], at[tail], chosen >> POS_BITS & (1 << 64 - POS_BITS) - 1, chosen & (1 << POS_BITS) - 1


class _Block:
    """Distinct pieces of the texts of one stretch of input: where each starts first, and which bytes surely go.

    `at` has the row of each distinct piece; the columns hold one entry a row, `same` the row of the equal piece met first.
    """

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.count = self.size = 0

    def add(self, ids: list[int], bases: list[int], parts: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        begin = np.cumsum(sizes) - sizes
        first, last, anchor, spot = anchors(raw, owner)
        self.size += len(raw)
        if not len(first):
            return
        whole, own, meet = raw.tobytes(), owner[first], self.at.setdefault
        rows = range(self.count, self.count + len(first))
        same = [meet(whole[a:z], k) for k, a, z in zip(rows, first.tolist(), (last + LENGTH).tolist())]
        doc, pos = np.array(ids, np.int64)[own], np.array(bases, np.int64)[own] + first - begin[own]
        self.columns.append((np.array(same), doc, pos, anchor, last + LENGTH - first, spot - first))
        self.count += len(first)

    def rows(self, shards: int) -> Iterator[tuple[int, int | None, bytes]]:
        if not self.at:
            return
        pack = zstandard.ZstdCompressor(level=3)
        same, doc, pos, anchor, size, inside = (np.concatenate(c) for c in zip(*self.columns))
        by = np.lexsort((pos, doc, same))
        head = np.flatnonzero(np.r_[True, np.diff(same[by]) != 0])
        lead = by[head]  # the earliest of equal pieces, in order of `same`, as `at` has them
        leader = np.repeat(lead, np.diff(np.r_[head, len(by)]))
        late = by[(doc[by] != doc[leader]) | (pos[by] != pos[leader])]
        shard = (anchor[lead] * 0x2545F491 >> 7) % shards
        pieces = list(self.at)
        order = np.lexsort((pos[lead], doc[lead], shard))
        bounds = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = lead[order[a:b]]
            head = np.array([len(own)], np.int64).tobytes()
            # a shard tells anchors apart well enough by 32 bits: a mix-up only compares more pieces
            numbers = (
                np.diff(doc[own], prepend=0), pos[own].astype(np.int32), anchor[own].astype(np.uint32), size[own].astype(np.uint8),
                inside[own].astype(np.uint8),
            )
            data = [head, *[x.tobytes() for x in numbers], *[pieces[k] for k in order[a:b].tolist()]]
            yield int(shard[order[a]]), None, pack.compress(b"".join(data))
        for gone, spans in spans_by_document(doc[late], pos[late], pos[late] + size[late]):
            yield hash(gone) % shards, gone, spans


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows; runs that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[head, 0], reach[np.r_[head[1:] - 1, len(spans) - 1]]], axis=1)


def spans_by_document(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(document, its maximal runs as packed rows); a document is moved to its own stretch of one long line."""
    ids, rank = np.unique(doc, return_inverse=True)
    base = rank << 40
    runs = merged(np.stack([start + base, end + base], axis=1))
    edges = np.searchsorted(runs[:, 0] >> 40, np.arange(len(ids) + 1)).tolist()
    runs &= (1 << 40) - 1
    for k, one in enumerate(ids.tolist()):
        yield one, runs[edges[k]:edges[k + 1]].tobytes()


def _deal(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: _Block) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row in block.rows(shards):
                held.append(row)
                size += len(row[2])
                if size > 4 << 20:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)

        def table(rows: list) -> pa.RecordBatch:
            shard, doc, data = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())], ["shard", "doc", "data"])

        block, ids, bases, parts, size = _Block(), [], [], [], 0
        for batch in batches:
            docs, texts = batch.column("doc"), batch.column("raw")
            for r in range(batch.num_rows):
                raw, doc = texts[r].as_py(), docs[r].as_py()
                for base in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT):
                    part = raw[base:base + SEGMENT + LENGTH - 1]
                    if len(part) < LENGTH:
                        continue
                    if size + len(part) > SEGMENT + LENGTH and parts:
                        block.add(ids, bases, parts)
                        ids, bases, parts, size = [], [], [], 0
                    ids.append(doc)
                    bases.append(base)
                    parts.append(part)
                    size += len(part)
                    if block.size > FLUSH:
                        yield from out(block)
                        block = _Block()
        if parts:
            block.add(ids, bases, parts)
        yield from out(block)

    return run


def _meets_another(pieces: list[bytes], inside: list[int]) -> np.ndarray:
    """Which distinct pieces have an anchor, with the REACH bytes before it or with those after it, that another has.

    Pieces that share a string share its anchor and one of these two; the rest have no string to be compared.
    """
    before: dict[bytes, list[int]] = {}
    after: dict[bytes, list[int]] = {}
    for k, (piece, i) in enumerate(zip(pieces, inside)):
        if i >= REACH:
            before.setdefault(piece[i - REACH:i + GRAM], []).append(k)
        if i + GRAM + REACH <= len(piece):
            after.setdefault(piece[i:i + GRAM + REACH], []).append(k)
    meets = np.zeros(len(pieces), bool)
    for side in (before, after):
        meets[[k for own in side.values() if len(own) > 1 for k in own]] = True
    return meets


def _earlier(payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(doc, removed spans) that one shard's pieces show, several a document."""
    unpack = zstandard.ZstdDecompressor()
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for data in payloads:  # first the numbers alone: an anchor met once needs no more
        raw = unpack.decompress(data)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        columns[0].append(np.cumsum(np.frombuffer(raw, np.int64, n, 8)))
        columns[1].append(np.frombuffer(raw, np.int32, n, 8 + 8 * n).astype(np.int64))
        columns[2].append(np.frombuffer(raw, np.uint32, n, 8 + 12 * n))
        columns[3].append(np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(np.int64))
        columns[4].append(np.frombuffer(raw, np.uint8, n, 8 + 17 * n).astype(np.int64))
    doc, pos, anchor, size, inside = (np.concatenate(c) for c in columns)
    _, same, often = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = often[same] > 1
    first: dict[bytes, int] = {}
    rows, same, seen = [np.zeros(0, np.int64)], [], 0
    for data in payloads:
        raw = unpack.decompress(data)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        own = np.flatnonzero(shared[seen:seen + n])
        z = np.cumsum(size[seen:seen + n])[own] + 8 + 18 * n
        own += seen
        same += [first.setdefault(raw[a:b], k) for k, a, b in zip(own.tolist(), (z - size[own]).tolist(), z.tolist())]
        rows.append(own)
        seen += n
    rows = np.concatenate(rows)
    same = np.array(same, np.int64)
    by = np.lexsort((pos[rows], doc[rows], same))
    head = np.flatnonzero(np.diff(same[by], prepend=-1))
    at = rows[by[head]]  # the earliest of equal pieces, in the order of `first`
    leader, member = np.repeat(at, np.diff(np.r_[head, len(by)])), rows[by]
    late = member[(doc[member] != doc[leader]) | (pos[member] != pos[leader])]
    gone = [(doc[late], pos[late], pos[late] + size[late])]
    several = _meets_another(list(first), inside[at].tolist())
    if several.any():
        pieces, at = [p for p, more in zip(first, several) if more], at[several]
        length = size[at]
        order, prefix = sorted_suffixes(pieces)
        begin = np.cumsum(length + 1) - length - 1
        of = np.searchsorted(begin, order, side="right") - 1
        offset = order - begin[of]
        group = np.cumsum(prefix < LENGTH)
        many = np.bincount(group)[group] > 1
        of, offset, group = of[many], offset[many], group[many]
        where_doc, where_pos = doc[at[of]], pos[at[of]] + offset
        rank = np.lexsort((where_pos, where_doc, group))
        head = np.r_[True, np.diff(group[rank]) != 0] if len(rank) else np.zeros(0, bool)
        lead = rank[head][np.cumsum(head) - 1] if len(rank) else rank
        later = rank[(where_doc[rank] != where_doc[lead]) | (where_pos[rank] != where_pos[lead])]
        gone.append((where_doc[later], where_pos[later], where_pos[later] + LENGTH))
    yield from spans_by_document(*(np.concatenate(c) for c in zip(*gone)))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        doc, data = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(data, pa.binary())], ["doc", "spans"])

    now, payloads = None, []
    for batch in batches:
        passed = []
        for shard, doc, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc", "data"))):
            if shard != now:
                if payloads:
                    yield table(list(_earlier(payloads)))
                now, payloads = shard, []
            if doc is None:
                payloads.append(data)
            else:
                passed.append((doc, data))
        yield table(passed)
    if payloads:
        yield table(list(_earlier(payloads)))


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc, spans): for each document with bytes to remove, packed (start, end) rows, in several parts."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    dealt = texts.where(F.length("raw") >= LENGTH).mapInArrow(_deal(partitions * SHARDS_PER_PARTITION), "shard int, doc long, data binary")
    return dealt.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(_judge, "doc long, spans binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the way to their spans."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw = pa.array([pack.compress(t) for t in batch.column("raw").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), raw], ["doc_id", "doc", "packed"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, packed, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "parts"))):
            raw = unpack.decompress(packed)
            spans = merged(np.frombuffer(b"".join(parts or ()), np.int64).reshape(-1, 2))
            digest, at, gone = hashlib.sha256(), 0, 0
            for a, b in spans.tolist():
                digest.update(raw[at:a])
                gone += b - a
                at = b
            digest.update(raw[at:])
            rows.append((doc, len(raw), gone, len(spans), digest.hexdigest(), spans.ravel().tolist()))
        kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every document; removed lists starts and ends.

    A byte goes if a 100-byte string covers it that also starts earlier, in a smaller doc_id or before in the same
    document; strings are judged on the input. Null texts count as empty; texts under 100 bytes lose nothing. A null
    id counts as smaller than all. Rows that share an id are judged as one document: the same place is not earlier
    than itself, so repeated rows lose the same bytes. Other columns are ignored; an empty table gives no rows.
    """
    spans = removed_spans(docs).groupBy("doc").agg(F.collect_list("spans").alias("parts"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    packed = texts.mapInArrow(_pack, f"doc_id {kind}, doc long, packed binary")
    return packed.join(spans, "doc", "left").select("doc_id", "packed", "parts").mapInArrow(
        _strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")
