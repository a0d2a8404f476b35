"""Byte-pair encoding of distinct words by a prefix-sharing trie walk, and decoding."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the split pattern of the byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_CHARS = 1 << 21
GROUP_WORDS = 1 << 19
MEMO_WORDS = 300_000


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizer file says: token bytes by id, merges by rank, special tokens."""

    def __init__(self, text: str):
        data = json.loads(text)
        signs = _byte_signs()
        self.ids = {bytes(signs[c] for c in token): k for token, k in data["model"]["vocab"].items() if all(c in signs for c in token)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {k: b for b, k in self.ids.items()} | {k: s.encode() for s, k in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        merges = [tuple(bytes(signs[c] for c in side) for side in pair) for pair in pairs]
        self.ranks = {(self.ids[x], self.ids[y]): rank for rank, (x, y) in enumerate(merges)}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (x, y) in enumerate(merges):
            self.made.setdefault(self.ids[x + y], (self.ids[x], self.ids[y], rank))
        self.edge: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.memo: dict[str, bytes] = {}
        self.fit: dict[tuple[int, int], bool] = {}

    def edges(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the left (0) or right (1) edge while the token is put together, the whole one
        first, each with the rank of the merge that ends its time there."""
        known = self.edge[side].get(token)
        if known is None:
            known, rest, until = [], token, 1 << 40
            while True:
                known.append((rest, until))
                if rest not in self.made:
                    break
                *parts, until = self.made[rest]
                rest = parts[side]
            self.edge[side][token] = known
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether b may follow a: encoding their bytes together gives just these two.

        It does unless tokens x and y that face each other across the border merge before either is taken up on its
        own side. Of equal ranks the leftmost merge comes first.
        """
        known = self.fit.get((a, b))
        if known is None:
            if len(self.fit) > 1_000_000:
                self.fit.clear()
            rank, left = self.ranks.get, self.edges(b, 0)
            known = self.fit[a, b] = not any(
                (r := rank((x, y))) is not None and r < until_x and r <= until_y for x, until_x in self.edges(a, 1) for y, until_y in left)
        return known

    def encode_words(self, words: Iterable[str]) -> None:
        """Put the encodings of distinct words into the memo.

        Sorted by their bytes, the words are the depth-first order of their trie. last[d] is the last token of the
        encoding of the first d bytes on the path; going down a byte, it is the one token that ends there and may
        follow the last token of what is before it. A word starts at the depth it shares with the one before, so a
        shared prefix is worked out once. The encoding is read back from the last token.
        """
        ids, sizes, follows = self.ids, {k: len(b) for k, b in self.bytes.items()}, self.follows
        last, begin, before = [0], [0], b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            n, shared = len(raw), 0
            limit = min(n, len(before))
            if raw[:limit] == before[:limit]:
                shared = limit
            else:
                while raw[shared] == before[shared]:
                    shared += 1
            del last[shared + 1:], begin[shared + 1:]
            for depth in range(shared + 1, n + 1):
                # there is just one such token, so any order of search finds it; most start where the one before did
                near = begin[depth - 1]
                for start in chain(range(near, depth), range(near - 1, max(-1, depth - self.longest - 1), -1)):
                    token = ids.get(raw[start:depth])
                    if token is not None and (start == 0 or follows(last[start], token)):
                        last.append(token)
                        begin.append(start)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            out, depth = [], n
            while depth:
                out.append(last[depth])
                depth -= sizes[last[depth]]
            self.memo[word] = array("I", reversed(out)).tobytes()
            before = raw

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, part): the text cut at its special tokens."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield False, text[at:m.start()]
            yield True, m.group()
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The words and special tokens of a text, in lists of GROUP_WORDS at most."""
        for special, part in self.parts(text):
            if special:
                yield [part]
            elif len(part) < GROUP_CHARS:
                yield self.split.findall(part)
            else:
                found = self.split.finditer(part)
                while block := [m.group() for m in islice(found, GROUP_WORDS)]:
                    yield block

    def encode(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """For each text its ids as little-endian 32-bit numbers, in blocks; texts go in groups of GROUP_CHARS."""
        group, size = [], 0
        for text in [*texts, None]:
            if text is None or size + len(text) > GROUP_CHARS and group:
                yield from self._group(group)
                group, size = [], 0
            if text is not None and len(text) >= GROUP_CHARS:
                yield (self._ids(block) for block in self.blocks(text))
            elif text is not None:
                group.append(text)
                size += len(text)

    def _group(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        lists = [[w for block in self.blocks(t) for w in block] for t in texts]
        self._learn(set().union(*lists))
        for words in lists:
            yield iter([b"".join(map(self.memo.__getitem__, words))])

    def _ids(self, words: list[str]) -> bytes:
        self._learn(set(words))
        return b"".join(map(self.memo.__getitem__, words))

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        for s, k in self.special.items():
            self.memo[s] = array("I", [k]).tobytes()
        self.encode_words(words - self.memo.keys())

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the tokens, one after the other."""
        return b"".join(map(self.bytes.__getitem__, ids))


_loaded: dict[int, Vocabulary] = {}


def encode_documents(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256 and decoded_sha256 of every text, and the ids if asked for.

    The vocabulary file is read by the driver and broadcast as text: its size is fixed, a few MB. Null texts count as
    empty and have no tokens. Special tokens written in a text are special; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Vocabulary(shared.value)
        vocabulary = _loaded[key]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                counts, sums, decoded, lists = [], [], [], []
                for blocks in vocabulary.encode([t or "" for t in batch.column("text").to_pylist()]):
                    n, digest, back = 0, hashlib.sha256(), hashlib.sha256()
                    own: list[bytes] = []
                    for block in blocks:
                        ids = array("I", block)
                        n += len(ids)
                        digest.update(block)
                        back.update(vocabulary.decode(ids).decode("utf-8", "replace").encode())
                        if with_ids:
                            own.append(block)
                    counts.append(n)
                    sums.append(digest.hexdigest())
                    decoded.append(back.hexdigest())
                    lists.append(b"".join(own))
                columns = [batch.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    values = pa.array(np.frombuffer(b"".join(lists), "<i4"))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), values))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
