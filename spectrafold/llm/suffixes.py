"""Induced suffix sorting in external memory, by numpy batches: the work of one shard inside a task.

Suffix tuples go through disk-backed queues keyed by their first symbol; each carries the length of the prefix it
shares with the suffix before it. Symbol 0 ends a piece: suffixes end there, and equal ones are in order of position.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CAP = 100  # prefixes are counted up to here
OPEN = 255  # no bound yet
IN_MEMORY = 1 << 20
CHUNK = 1 << 18
BUCKET = 1 << 10
BASE = 1 << 15  # names of the base case of the recursion


class BucketQueue:
    """First-in-first-out queues of suffix tuples, one for each bucket of symbols: position and prefix in one number.

    A priority queue by bucket, then by arrival. Above IN_MEMORY tuples, what waits is appended to one file a bucket.
    """

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name
        self.size = 0
        self.near: dict[int, list[np.ndarray]] = {}
        self.read_at: dict[int, int] = {}
        self.filed: set[int] = set()

    def push(self, bucket: np.ndarray, rows: np.ndarray) -> None:
        """Rows with their bucket, in order of arrival."""
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        for a, b in zip(starts, [*starts[1:], len(bucket)]):
            self.near.setdefault(int(bucket[a]), []).append(rows[a:b])
        self.size += len(rows)
        if self.size > IN_MEMORY:
            for b, parts in self.near.items():
                self.filed.add(b)
                with open(self._path(b), "ab") as file:
                    for part in parts:
                        file.write(part.tobytes())
            self.near, self.size = {}, 0

    def _path(self, bucket: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{bucket}")

    def take(self, bucket: int, most: int | None = None) -> np.ndarray:
        """The next rows of a bucket, `most` of the stored ones at a time; empty when none is left."""
        stored = np.zeros(0, np.int64)
        if bucket in self.filed:
            at = self.read_at.get(bucket, 0)
            stored = np.fromfile(self._path(bucket), np.int64, -1 if most is None else most, offset=at)
            self.read_at[bucket] = at + stored.nbytes
            if most is not None and len(stored):
                return stored
        parts = self.near.pop(bucket, [])
        self.size -= sum(map(len, parts))
        return np.concatenate([stored, *parts])


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for each pair with first <= last."""
    width = np.zeros(len(first), np.int64)
    span = last - first + 1
    levels = [values]
    for k in range(1, int(span.max(initial=1)).bit_length()):
        before, step = levels[-1], 1 << (k - 1)
        levels.append(np.minimum(before[:-step], before[step:]) if len(before) > step else before)
    width = np.frexp(span.astype(float))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(width):
        own = width == k
        out[own] = np.minimum(levels[k][first[own]], levels[k][last[own] - (1 << int(k)) + 1])
    return out


class _Prefixes:
    """For each symbol, the least prefix since its last inducer; gives the prefixes that induced tuples carry."""

    def __init__(self, symbols: int):
        self.seen, self.least = np.zeros(symbols, bool), np.full(symbols, OPEN, np.uint8)

    def step(self, lcp: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """lcp of a batch to what came before each; at: the inducers in it, ascending; symbol: what each induces."""
        out = np.zeros(len(at), np.uint8)
        if len(at):
            order = np.argsort(symbol, kind="stable")
            s, r = symbol[order], at[order]
            head = np.r_[True, s[1:] != s[:-1]]
            got = np.zeros(len(s), np.uint8)
            inner = np.flatnonzero(~head)
            if len(inner):
                got[inner] = np.minimum(_range_min(lcp, r[inner - 1] + 1, r[inner]), CAP - 1) + 1
            heads = np.flatnonzero(head)
            upto = np.minimum.accumulate(lcp)
            first = np.minimum(np.minimum(self.least[s[heads]], upto[r[heads]]), CAP - 1) + 1
            got[heads] = np.where(self.seen[s[heads]], first, 0)
            out[order] = got
        self.least = np.minimum(self.least, lcp.min(initial=OPEN))
        if len(at):
            tails = np.r_[heads[1:] - 1, len(s) - 1]
            after = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], OPEN]
            self.least[s[tails]] = after[r[tails] + 1]
            self.seen[s[tails]] = True
        return out


def _runs(s: np.ndarray) -> np.ndarray:
    """How often each position's symbol goes on from there."""
    ends = np.flatnonzero(np.r_[s[1:] != s[:-1], True])
    return ends[np.searchsorted(ends, np.arange(len(s)))] - np.arange(len(s)) + 1


def _induce(
    s: np.ndarray, key: np.ndarray, target: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, run: np.ndarray | None, symbols: int,
    folder: str, name: str,
) -> tuple[np.ndarray, np.ndarray | None]:
    """Positions of the target type in order of (key, arrival), with the prefix each shares with the one before.

    seeds are the sorted suffixes of the other type; in a bucket they come after what is induced. With run given
    there are few symbols: a bucket is one symbol, read chunk by chunk, and prefixes are carried. Else buckets hold
    many symbols and are taken whole: the longest stretch into which none of its own induces anything goes at once.
    """
    shift = 0 if run is not None else max(0, int(symbols).bit_length() - max(5, (len(s) // BUCKET).bit_length()))
    queue, prefixes = BucketQueue(folder, name), _Prefixes(symbols) if run is not None else None
    edges = np.searchsorted(key[seeds] >> shift, np.arange((symbols >> shift) + 2))
    before = np.zeros(len(s), bool)  # a suffix of the target type, of the same piece, is right before it
    before[1:] = target[:-1] & (s[:-1] > 0)
    out: list[np.ndarray] = [np.zeros(0, np.int64)]

    def induce(pos: np.ndarray, lcp: np.ndarray) -> None:
        at = np.flatnonzero(before[pos])
        new = pos[at] - 1
        to = key[new]
        queue.push(to, new << 8 | prefixes.step(lcp, at, to))

    for b in range((symbols >> shift) + 1):
        own = seeds[edges[b]:edges[b + 1]]
        if run is not None:
            last = -1
            while len(rows := queue.take(b, CHUNK)):
                out.append(rows)
                last = rows[-1] >> 8
                induce(rows >> 8, (rows & 255).astype(np.uint8))
            for at in range(0, len(own), CHUNK):
                part, lcp = own[at:at + CHUNK], seed_lcp[edges[b] + at:edges[b] + at + CHUNK].copy()
                if at == 0:
                    lcp[0] = min(run[last], run[part[0]], CAP) if last >= 0 else 0
                induce(part, lcp)
            continue
        pending = np.concatenate([queue.take(b), own << 1 | 1])  # the last bit marks seeds
        while len(pending):
            pos = pending >> 1
            rank = key[pos] << 1 | pending & 1
            order = np.argsort(rank, kind="stable")
            pending, pos, rank = pending[order], pos[order], rank[order]
            at = np.flatnonzero(before[pos])
            goes = key[pos[at] - 1]
            bound = np.full(len(pos), symbols + 1)
            bound[at] = goes
            bound = np.minimum.accumulate(bound) << 1
            late = np.flatnonzero(rank[1:] > bound[:-1])
            stop = late[0] + 1 if len(late) else len(pos)
            done, at, goes = pending[:stop], at[at < stop], goes[: np.searchsorted(at, stop)]
            out.append(done[done & 1 == 0] >> 1)
            new = (pos[at] - 1) << 1
            here = goes >> shift == b
            queue.push(goes[~here] >> shift, new[~here])
            # what was induced earlier comes before what is induced now; seeds of a symbol come last by their mark
            pending = np.concatenate([pending[stop:], new[here]])
    rows = np.concatenate(out)
    return (rows >> 8, (rows & 255).astype(np.uint8)) if run is not None else (rows, None)


def _names(s: np.ndarray, low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Ranks of the stretches s[start..stop] by symbol and type; those that start with symbol 0 get 0."""
    symbol = s.astype(np.int64) * 2 + low
    bits = int(symbol.max(initial=1)).bit_length()
    per = max(1, 62 // bits)
    rank, done = np.zeros(len(starts), np.int64), 0
    active = np.arange(len(starts))
    while len(active):
        packed = np.zeros(len(active), np.int64)
        for k in range(per):
            at = starts[active] + done + k
            packed = (packed << bits) | np.where(at <= stops[active], symbol[np.minimum(at, len(s) - 1)], 0)
        sub = np.zeros(len(starts), np.int64)
        sub[active] = np.unique(packed, return_inverse=True)[1] + 1
        rank = np.unique(rank * (sub.max() + 1) + sub, return_inverse=True)[1]
        done += per
        active = active[starts[active] + done <= stops[active]]
    # all that start with 0 end at once and rank first
    ends = s[starts] == 0
    rank = rank + 1 - (rank[ends].max() + 1 if ends.any() else 0)
    rank[ends] = 0
    return rank


def _common(s: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes a and b of 16-bit symbols, up to CAP; left: symbols before the end of a piece."""
    padded = np.r_[s, np.zeros(4, s.dtype)]
    four = np.ndarray(len(s), "<u8", padded, strides=(2,))  # four symbols from each position on
    most = np.minimum(np.minimum(left[a], left[b]), CAP)
    out = np.zeros(len(a), np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        differ = four[a[active] + out[active]] ^ four[b[active] + out[active]]
        lowest = differ & (~differ + np.uint64(1))
        out[active] += np.where(differ == 0, 4, np.frexp(lowest.astype(float))[1] - 1 >> 4)
        active = active[(differ == 0) & (out[active] < most[active])]
    return np.minimum(out, most)


def _doubled(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of few symbols, by ranks of prefixes of doubled length; 0 ends every piece."""
    n = len(s)
    ends = np.flatnonzero(s == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    rank, kinds, reach = np.unique(s, return_inverse=True)[1], 0, 1
    while rank.max() + 1 > kinds and reach <= left.max():
        kinds = int(rank.max()) + 1
        on = np.where(left >= reach, rank[np.minimum(np.arange(n) + reach, n - 1)] + 1, 0)
        rank, reach = np.unique(rank * (kinds + 1) + on, return_inverse=True)[1], reach * 2
    return np.argsort(rank, kind="stable")


def suffix_order(s: np.ndarray, symbols: int, folder: str, depth: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """(positions of all suffixes in order, prefix each shares with the one before); 0 ends every piece, also the last.

    Leftmost small suffixes are sorted by names of the stretches between them, by recursion unless the names tell
    them all apart or are few enough to be ranked directly, the base case; they induce the large suffixes, and those the small ones. Prefixes are given at depth 0 alone.
    """
    n = len(s)
    ends = np.flatnonzero(s == 0)
    if len(ends) == n:
        return ends, None
    up = np.r_[s[:-1] < s[1:], True]
    differ = np.flatnonzero(np.r_[s[:-1] != s[1:], True])
    low = up[differ[np.searchsorted(differ, np.arange(n))]]  # small: below the suffix that follows
    low[ends] = True
    starts = np.flatnonzero(low & np.r_[False, ~low[:-1]])
    stops = np.r_[starts[1:], n - 1]
    stops[s[starts] == 0] = starts[s[starts] == 0]
    names = _names(s, low, starts, stops)
    inner = names[names > 0]
    if len(np.unique(inner)) == len(inner):
        order = np.argsort(names, kind="stable")
    elif len(names) <= BASE:
        order = _doubled(names)
    else:
        order, _ = suffix_order(names, int(names.max()) + 1, folder, depth + 1)
    seeds = starts[order]
    run = _runs(s) if depth == 0 else None
    key = s.astype(np.int64)
    lcp = None
    if run is not None:
        lcp = np.zeros(len(seeds), np.uint8)
        lcp[1:] = _common(s, seeds[:-1], seeds[1:], ends[np.searchsorted(ends, np.arange(n))] - np.arange(n))
    large, large_lcp = _induce(s, key, ~low, seeds, lcp, run, symbols, folder, f"{depth}-large")
    back = large[::-1]
    back_lcp = np.r_[np.uint8(0), large_lcp[:0:-1]] if run is not None else None
    down, down_lcp = _induce(s, symbols - 1 - key, low & (s > 0), back, back_lcp, run, symbols, folder, f"{depth}-small")
    small = down[::-1]
    both = np.r_[ends, large, small]
    kind = np.r_[np.zeros(len(ends), np.int64), np.zeros(len(large), np.int64), np.ones(len(small), np.int64)]
    final = np.argsort(key[both] * 2 + kind, kind="stable")
    if run is None:
        return both[final], None
    small_lcp = np.r_[np.uint8(0), down_lcp[:0:-1]] if len(small) else np.zeros(0, np.uint8)
    prefix = np.r_[np.zeros(len(ends), np.uint8), large_lcp, small_lcp][final]
    pos, kind = both[final], kind[final]
    turn = np.flatnonzero((key[pos[1:]] == key[pos[:-1]]) & (kind[1:] != kind[:-1])) + 1
    prefix[turn] = np.minimum(np.minimum(run[pos[turn]], run[pos[turn - 1]]), CAP)
    prefix[1:][key[pos[1:]] != key[pos[:-1]]] = 0
    return pos, prefix


def sorted_suffixes(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """suffix_order of pieces of bytes, each ended by symbol 0; the queues' files are gone when it returns."""
    text = np.zeros(sum(map(len, pieces)) + len(pieces), np.int16)
    inside = np.ones(len(text), bool)
    inside[np.cumsum([len(p) + 1 for p in pieces]) - 1] = False
    text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int16) + 1
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        return suffix_order(text, 257, folder)
