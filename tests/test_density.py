"""Neighbour lists, spanning trees and the hierarchy of density, against sequential versions."""

from __future__ import annotations

import numpy as np
import pytest
from brute import labels_of, tree_of

from plenum.operators import hierarchy, neighbours


def made(spark, vectors, unit=False):
    return neighbours.points(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "id long, v array<double>"), "id", "v", unit=unit)


def whole(p):
    rows = p.orderBy("id").collect()
    return [r["id"] for r in rows], [r["v"] for r in rows]


def check(spark, vectors, k, min_size, min_samples, exact=True):
    p = made(spark, vectors)
    ids, v = whole(p)
    want = tree_of(ids, v, min_samples)
    found = neighbours.exact_neighbours(p, k)
    tree = hierarchy.spanning_tree(p, found, hierarchy.core_distances(found, min_samples), exact)
    got = sorted((r["w"], r["a"], r["b"]) for r in tree.collect())
    if exact:
        assert got == want
    else:
        assert len(got) == len(want) and sum(x[0] for x in got) <= 1.01 * sum(x[0] for x in want)
    labels = {r["id"]: r["topic"] for r in hierarchy.cluster_labels(tree, p, min_size).collect()}
    assert labels == labels_of(ids, got, min_size)
    return labels


def test_hierarchy_of_500_vectors(spark):
    rng = np.random.default_rng(1)
    labels = check(spark, [(3 * k - 40, x) for k, x in enumerate(rng.normal(size=(500, 3)))], 15, 5, 3)
    assert len(set(labels.values())) >= 3 and -1 in labels.values()


def test_hierarchy_of_copies(spark):
    """Equal vectors and equal distances: edges are told apart by their ids."""
    rng = np.random.default_rng(2)
    check(spark, list(enumerate(np.concatenate([rng.integers(0, 6, size=(200, 2)), np.zeros((40, 2))]))), 6, 5, 3)


def test_hierarchy_over_listed_edges(spark):
    """Lists that do not connect all points: the least edges between components are searched for."""
    rng = np.random.default_rng(3)
    blobs = np.concatenate([rng.normal(c, 0.2, size=(40, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    labels = check(spark, list(enumerate(blobs)), 5, 10, 5, exact=False)
    assert len(set(labels.values()) - {-1}) >= 3


def test_hierarchy_of_few_points(spark):
    assert check(spark, [(1, [0, 0]), (2, [1, 0]), (3, [5, 5])], 5, 5, 3) == {1: -1, 2: -1, 3: -1}
    assert check(spark, [(1, [0, 0])], 5, 2, 1) == {1: -1}
    p = made(spark, [(1, [0.0])]).limit(0)
    found = neighbours.exact_neighbours(p, 3)
    assert hierarchy.cluster_labels(hierarchy.spanning_tree(p, found, hierarchy.core_distances(found)), p).count() == 0
    assert neighbours.forest_neighbours(p, 3).count() == 0


def test_points(spark):
    """Rows without an id or a vector, and unit vectors of no length, take no part; lengths must agree."""
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (None, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in neighbours.points(rows, "id", "v", bits=4).collect()] == [(1, [9, 12])]
    with pytest.raises(ValueError, match="lengths"):
        neighbours.points(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v")


def test_neighbours(spark, monkeypatch):
    """Exact lists in waves, ties by id; the forest's lists hold nine tenths of them, copies included."""
    monkeypatch.setattr(neighbours, "WAVE", 500)
    rng = np.random.default_rng(4)
    p = made(spark, list(enumerate(np.concatenate([rng.normal(size=(400, 6)), np.ones((100, 6)), rng.integers(0, 2, size=(60, 6))]))))
    ids, v = whole(p)
    v = np.array(v, dtype=object)
    want = set()
    for i in ids:
        d = sorted((int(((v[i] - v[j]) ** 2).sum()), j) for j in ids if j != i)
        want |= {(i, j, x, r + 1) for r, (x, j) in enumerate(d[:7])}
    right = neighbours.exact_neighbours(p, 7)
    assert {(r["src"], r["dst"], r["d"], r["rank"]) for r in right.collect()} == want
    found = neighbours.forest_neighbours(p, 7, leaf=32)
    rows = found.collect()
    own = {(i, j): d for i, j, d, _ in want}
    assert all(own.get((r["src"], r["dst"]), r["d"]) == r["d"] and r["src"] != r["dst"] for r in rows)
    last = {i: max(d for a, _, d, _ in want if a == i) for i in ids}
    assert sum(r["d"] <= last[r["src"]] for r in rows) >= 0.95 * 7 * len(ids)  # copies stand for each other


def test_membership_weights(spark):
    rng = np.random.default_rng(5)
    found = neighbours.exact_neighbours(made(spark, list(enumerate(rng.normal(size=(60, 3))))), 8)
    got = {(r["a"], r["b"]): r["weight"] for r in neighbours.membership_weights(found, 8).collect()}
    one = {}
    for i in range(60):
        d = {r["dst"]: float(np.sqrt(r["d"])) for r in found.collect() if r["src"] == i}
        near = min(d.values())
        lo, hi = 1e-9, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(np.exp(-(x - near) / mid) for x in d.values()) > 3 else (mid, hi)
        one |= {(i, j): float(np.exp(-(x - near) / hi)) for j, x in d.items()}
    want = {(min(i, j), max(i, j)): w + one.get((j, i), 0) - w * one.get((j, i), 0) for (i, j), w in one.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
