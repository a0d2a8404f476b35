"""Near-duplicate sets: stars of buckets, buckets that stay split, chains and hubs, against brute force."""

import random

import numpy as np
import pytest

from spectrafold.llm import near


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def smallest_reachable(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_alike_equals_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50), np.uint64)) for _ in range(80)] + [np.zeros(0, np.uint64)]
    for own in sets[::5] + sets[-1:]:
        want = [jaccard(set(own.tolist()), set(s.tolist())) >= 0.5 for s in sets]
        assert near.alike(own, sets, 0.5).tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_forest_with_groups_connects_what_links_and_groups_connect(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 40), np.uint64)) for _ in range(60)]
    groups = rng.integers(0, 40, 60).tolist()
    kin = [(a, b) for a in range(60) for b in range(a) if groups[a] == groups[b]]
    links = [(a, b) for a in range(60) for b in range(a) if jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.6]
    us, vs = near.forest(sets, 0.6, groups)
    assert all((max(p), min(p)) in set(links) for p in zip(us, vs)) and all(groups[u] != groups[v] for u, v in zip(us, vs))
    assert smallest_reachable(60, kin + list(zip(us, vs))) == smallest_reachable(60, kin + links)


def test_buckets_of_template_text_with_several_groups(spark, monkeypatch):
    """Texts share most of a template, so bands hold several groups, and no link leads to the least of a bucket."""
    monkeypatch.setattr(near, "TILE", 8)
    rng = random.Random(4)
    template = [f"t{k}" for k in range(120)]
    texts = []
    for g in range(12):
        own = [f"g{g}x{k}" for k in range(60)]
        for _ in range(6):
            words = template + own
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    texts += ["", "   ", texts[0].upper()]
    rows = list(enumerate(texts)) + [(None, texts[0]), (2, texts[2]), (500, None)]
    frame = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    kept = near.representatives(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1
    assert sorted(i for i in ids if i is not None) == sorted(set(smallest_reachable(len(texts), links)))


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near.representatives(none).collect() == []
    lone = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near.representatives(lone).collect()) == [1, 2]
