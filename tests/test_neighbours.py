"""Similarity join and neighbourhood function against brute force."""

import math
import random
from collections import deque

import pytest

from spectrafold.operators import graphs, neighbours


def _brute(rows, radius):
    rows = {(i, tuple(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for i, v in rows:
        own = min(j for j, w in rows if w == v)
        out[i] = (own, sum(len(w) == len(v) and math.dist(v, w) <= radius for _, w in rows) - 1)
    return out


def _counts(spark, rows, radius):
    df = spark.createDataFrame(rows, "doc long, v array<double>")
    return {r.id: (r.class_id, r.n_links) for r in neighbours.similarity_counts(df, "doc", "v", radius).collect()}


@pytest.mark.parametrize("dims,radius", [(1, 0.05), (3, 0.2), (8, 0.7)])
def test_similarity_counts_equal_brute_force(spark, dims, radius, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)  # dense cells fall into many tiles
    rng = random.Random(dims)
    rows = [(i, [rng.random() for _ in range(dims)]) for i in range(220)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(90)]  # copies
    assert _counts(spark, rows, radius) == _brute(rows, radius)


def test_distance_equal_to_the_radius_links(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0000001])]
    assert _counts(spark, rows, 5.0) == {1: (1, 1), 2: (2, 2), 3: (3, 1)}


def test_unusable_vectors_other_lengths_and_repeated_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0])]
    want = {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0)}
    assert _counts(spark, rows, 0.5) == want


def test_empty_table_and_radius(spark):
    assert _counts(spark, [], 1.0) == {}
    with pytest.raises(ValueError):
        _counts(spark, [(1, [1.0])], 0.0)


def _exact(edges):
    """(average path, pairs, diameter) over all nodes."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    found = []
    for start in near:
        dist, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for other in near[at]:
                if other not in dist:
                    dist[other] = dist[at] + 1
                    queue.append(other)
        found += [x for x in dist.values() if x]
    return sum(found) / len(found), len(found), max(found)


def test_distance_estimates_of_grid_and_random_graphs(spark):
    rng = random.Random(5)
    grid = {((x, y), (x + dx, y + dy)) for x in range(9) for y in range(9) for dx, dy in ((0, 1), (1, 0)) if x + dx < 9 and y + dy < 9}
    grid = {(a[0] * 9 + a[1], b[0] * 9 + b[1]) for a, b in grid}
    loose = {tuple(rng.sample(range(150), 2)) for _ in range(220)}
    both = {"grid": {e for a, b in grid for e in ((a, b), (b, a))}, "loose": {e for a, b in loose for e in ((a, b), (b, a))}}
    rows = [(name, a, b) for name, edges in both.items() for a, b in edges]
    df = spark.createDataFrame(rows, "graph_id string, src long, dst long")
    got = {r.graph_id: r for r in graphs.distance_estimates(graphs.neighbourhood_function(df)).collect()}
    for name, edges in both.items():
        mean, pairs, diameter = _exact(edges)
        assert abs(got[name].est_avg_path / mean - 1) < 0.03
        assert abs(got[name].est_reached / pairs - 1) < 0.03
        assert got[name].est_effective_diameter <= got[name].est_diameter == diameter


def test_tiles_of_a_dense_cell_meet_once_and_give_sums_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 50)
    rng = random.Random(9)
    rows = [(i, [5.0 + rng.random() / 100, rng.random() / 100]) for i in range(300)]
    classes = neighbours.vector_classes(spark.createDataFrame(rows, "id long, vector array<double>"))
    tiles = classes.count() // 50
    assert neighbours._tile_pairs(classes, 1.0).count() <= 9 * tiles * (tiles + 1) // 2
    found = {r.class_id: r._others for r in neighbours._link_counts(classes, 1.0).collect()}
    assert found == {i: 299 for i in range(300)}


def test_null_entries_link_with_nothing_and_hide_no_other_links(spark):
    rows = [(i, [i / 10, None if i % 2 else 1.0]) for i in range(20)]
    classes = neighbours.vector_classes(spark.createDataFrame(rows, "id long, vector array<double>"))
    got = {(r.a, r.b) for r in neighbours.class_links(classes, 0.25).collect()}
    assert got == {(i, i + 2) for i in range(0, 18, 2)}
