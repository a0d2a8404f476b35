"""Merkle manifest, hard negatives and benchmark hits against plain Python, with edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import decontaminate, merkle, negatives, queries
from spectrafold.llm.common import read

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf int, hash string, pos int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(hashes):
    """(root, proof of each leaf as (before, after) texts)."""
    proofs, level, spots = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        for leaf, spot in enumerate(spots):
            low = spot // 3 * 3
            proofs[leaf].append(("".join(level[low:spot]), "".join(level[spot + 1:low + 3])))
        level = [sha(*level[k:k + 3]) for k in range(0, len(level), 3)]
        spots = [s // 3 for s in spots]
    return level[0], proofs


def plain_manifest(rows):
    leaves = {}
    for row in rows:
        doc_id, text, lang, source, n_chars = row[:5]
        head = [doc_id, source, lang, n_chars]
        odd = doc_id is None or zlib.crc32(str(doc_id).encode()) % 2
        seen = text if odd or text is None else text.replace("\n", "")
        leaves.setdefault(source, []).append((doc_id, sha(*map(field, [*head, text])), sha(*map(field, [*head, seen]))))
    out, order = [], sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        leaves[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = plain_tree([r[1] for r in leaves[source]])
    root, above = plain_tree([trees[s][0] for s in order])
    for source, trunk in zip(order, above):
        for (doc_id, leaf, seen), proof in zip(leaves[source], trees[source][1]):
            whole, now = proof + trunk, seen
            for before, after in whole:
                now = sha(before, now, after)
            out.append((doc_id, leaf, trees[source][0], root, sha(*[a + b for a, b in whole]), now, now == root))
    return out


def doc_rows(n):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "a\nb é中", "x" * 3000 + "\n", "plain"]) if k % 2 else f"text {k}\n\nend"
        rows.append((k if k % 9 else None, text, rng.choice([None, "en", ""]), rng.choice([None, "", "a", "B", "é", "a", "a"]), k, "t", 1, "h", 2))
    return rows + rows[:4] + [(700, "lone\n", "en", "only one", 1, "t", 1, "h", 2)]


@pytest.mark.parametrize("rows", [doc_rows(60), doc_rows(0), doc_rows(60)[1:2]])
def test_manifest_equals_a_plain_tree(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_nothing_and_other_fanouts(spark):
    docs = spark.createDataFrame(doc_rows(40), DOCS)
    make = lambda d, n: merkle.verify(merkle.manifest(
        d, "source", "doc_id", merkle.leaf_digest(F.col("doc_id"), F.col("text")), {"pos": F.col("pos"), "seen": merkle.leaf_digest(F.col("doc_id"), F.col("text"))}, n), "seen")
    assert make(docs.limit(0), 3).collect() == []
    for fanout in (2, 7):
        rows = make(docs, fanout).collect()
        assert len(rows) == 45 and all(r.verified and r.pos == 2 for r in rows) and len({r.root for r in rows}) == 1


def plain_negatives(rows, is_anchor):
    def sound(v):
        return v and all(c is not None and math.isfinite(c) for c in v)

    whole = sorted({(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and sound(v)})
    ints = [(i, label, [math.floor(256 * c) for c in v]) for i, label, v in whole]
    clamp = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    out = []
    for n, (i, label, v) in enumerate(ints):
        if not is_anchor(i):
            continue
        met = sorted((-clamp(sum(a * b for a, b in zip(v, w))), j, lab) for m, (j, lab, w) in enumerate(ints) if m != n and len(w) == len(v))
        for score, j, _ in [x for x in met if x[2] == label][:5]:
            fit = [x for x in met if x[2] != label and 80 * -score <= 100 * -x[0] <= 100 * -score][:5]
            out += [(i, j, k + 1, x[1], -score, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def vectors(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(k, (centres[rng.integers(4)] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(3))) for k in range(n)]


@pytest.mark.parametrize("cells", [1 << 18, 160])
def test_negatives_equal_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(negatives, "CELLS", cells)
    rows = vectors(90, 8, 0.3, 1) + [(200 + k, [float(k % 3), 1.0, 0.0], k % 2) for k in range(20)]  # ties, another length
    rows += [(300, [0.0] * 8, 0), (301, None, 1), (302, [1.0, None], 1), (303, [math.nan] * 8, 1), (304, [math.inf] * 8, 2), (None, [1.0] * 8, 1),
             (305, [1.0] * 8, None), (306, [], 1), rows[0], rows[0]]
    rows += [(400 + k, [(-1.0) ** k * 3e38, 2.0 + k], k % 2) for k in range(8)]  # scores beyond 64 bits
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, key string").repartition(3)
    read(spark, SF, "embeddings")
    got = negatives.hard_negatives(frame, F.col("vec_id") % 2 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i % 2 == 0) and got
    assert negatives.hard_negatives(frame.limit(0), F.lit(True)).collect() == []


def test_threshold_search_stops_before_the_end():
    x = np.array([[k, k] for k in range(5000)])
    lists = negatives.Lists(x)
    touched = []
    lists.real = Watched(lists.real, touched)
    assert lists.best(np.array([2, 1]), np.full(5000, True), [None], 3) == [[(3 * 4999, 4999), (3 * 4998, 4998), (3 * 4997, 4997)]]
    assert max(touched) < 100


class Watched:
    """An array that notes how many rows are taken at once."""

    def __init__(self, array, sizes):
        self.array, self.sizes = array, sizes

    def __getitem__(self, at):
        if not isinstance(at, tuple):
            self.sizes.append(len(at))
        return self.array[at]


def plain_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(item) if item is not None else "")
    out = []
    for doc_id, text in texts:
        w, hit, names = words(text), set(), set()
        for size in range(1, 11):
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k:k + size]))):
                    hit |= set(range(k, k + size))
                    names |= found
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return sorted(out, key=repr)


def hit_rows(short):
    rng = random.Random(5)
    vocabulary = ["a", "b", "it", "éa", "中文", "word", "longerword", "x1", "9", "the"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.choice([10, 11, 14, 30]))) for k in range(40)] + [(None, line(12)), (3, line(10)), (50, None), (51, " ;; ")]
    items += [(90, "a b"), (91, "rare"), (10, "Longerword, THE 9 9 it"), (92, items[0][1])] if short else []
    docs = [(k, line(rng.choice([0, 1, 5, 9, 10, 50, 400]))) for k in range(60)]
    for k in range(40):
        cut = items[k][1].split()
        at = rng.randrange(len(cut))
        docs.append((100 + k, f"{line(7)}, {'; '.join(cut[at:at + 12]).upper().replace('É', 'é')}!\n{items[k][1]} {items[k][1]} {line(3)}"))
    docs += [(None, None), (None, ""), (7, items[1][1] + "s"), (7, items[1][1]), (7, items[1][1]), (8, line(40_000) + " " + items[2][1]), (9, "rare." * 3)]
    return docs, items


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("group", [100_000, 150])
def test_hits_equal_plain_search(spark, tmp_path, monkeypatch, short, group):
    docs, items = hit_rows(short)
    spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, n_words int, items string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, words int").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = decontaminate.occurrences
    monkeypatch.setattr(decontaminate, "occurrences", lambda d, b: whole(d, b, group=group))
    got = queries.op13_benchmark_hits(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_hits(docs, items)


def test_hits_of_empty_tables(spark):
    read(spark, SF, "documents")
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id string, text string")
    assert decontaminate.occurrences(docs.limit(0), items).collect() == []
    assert [tuple(r) for r in decontaminate.occurrences(docs, items.limit(0)).collect()] == [(1, 3, [], [])]
    assert [tuple(r) for r in decontaminate.occurrences(docs, items).collect()] == [(1, 3, [(0, 2)], ["1"])]
