"""Small graphs with known answers."""

from __future__ import annotations

import math

import pytest

from plenum.operators import graphs, kernels
from plenum.operators.components import connected_components


def edges(spark, pairs, w=1.0):
    return spark.createDataFrame([(a, b, w) for a, b in pairs], "src long, dst long, weight double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


PATH = [(1, 2), (2, 3)]
BRIDGE = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def test_components_of_a_long_path_and_a_forest(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(edges(spark, pairs)).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_of_nothing(spark):
    assert connected_components(edges(spark, [])).count() == 0


def test_betweenness_and_harmonic_of_a_path(spark):
    e, n = edges(spark, PATH), nodes(spark, [1, 2, 3])
    assert {r["node"]: r["betweenness"] for r in kernels.betweenness(n, e).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}
    assert {r["node"]: r["harmonic"] for r in kernels.harmonic(n, e).collect()} == {1: 0.75, 2: 1.0, 3: 0.75}
    assert graphs.degree_metrics(e, n).first()["density"] == pytest.approx(2 / 3, abs=1e-6)


def test_weights_are_distances_unless_inverted(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 1.0)], "src long, dst long, weight double")
    n = nodes(spark, [1, 2, 3])
    assert {r["node"]: r["betweenness"] for r in kernels.betweenness(n, e, weighted=True).collect()}[2] == 0.0
    assert {r["node"]: r["betweenness"] for r in kernels.betweenness(n, e, weighted=True, inverse=True).collect()}[2] == 1.0


def test_louvain_finds_two_triangles(spark):
    found, q = kernels.communities(edges(spark, BRIDGE))
    got = {r["node"]: r["community"] for r in found.collect()}
    assert len({got[1], got[2], got[3]}) == 1 and len({got[4], got[5], got[6]}) == 1 and got[1] != got[4]
    labels = nodes(spark, range(1, 7)).selectExpr("node", "node <= 3 as label")
    assert q == pytest.approx(graphs.label_modularity(edges(spark, BRIDGE), labels).first()["q"], abs=1e-6) == pytest.approx(5 / 14, abs=1e-6)


def test_eigenvector_agrees_locally_and_distributed(spark, monkeypatch):
    e = edges(spark, BRIDGE)
    local = {r["node"]: r["eigenvector"] for r in kernels.eigenvector(e).collect()}
    monkeypatch.setattr(kernels, "LOCAL_EDGES", 1)
    far = {r["node"]: r["eigenvector"] for r in kernels.eigenvector(e, tol=1e-4).collect()}
    assert sum(x * x for x in local.values()) == pytest.approx(1, abs=1e-4)
    assert all(math.isclose(local[v], far[v], abs_tol=2e-3) for v in local)


def test_star_has_a_core(spark):
    core, fit = kernels.core_fit(kernels.adjacency(edges(spark, [(0, i) for i in range(1, 8)])))
    assert core == {0} and fit == pytest.approx(1.0)
    assert 0 < kernels.core_periphery(edges(spark, BRIDGE), nulls=5).first()["p_value"] <= 1


def test_stance_example(spark):
    """Alice (A +1, B -1), Bob (A +1, B +.5, C 0), Carol (B -1, C +1)."""
    rows = [(0, 1, 0, 1.0), (0, 1, 1, -1.0), (0, 2, 0, 1.0), (0, 2, 1, 0.5), (0, 2, 2, 0.0), (0, 3, 1, -1.0), (0, 3, 2, 1.0)]
    m = graphs.mean_stance(spark.createDataFrame(rows, "case_id long, actor long, theme long, stance double"))
    pick = lambda agree: {(r["src"], r["dst"], r["weight"]) for r in graphs.stance_edges(m, agree).collect()}
    assert pick(True) == {(1, 2, 1), (1, 3, 1)} and pick(False) == {(1, 2, 1), (2, 3, 1)}


def test_subgraph_keeps_edges_with_both_ends(spark):
    assert graphs.within(edges(spark, BRIDGE), nodes(spark, [1, 2, 3, 5])).count() == 3
    assert graphs.crossing_share(edges(spark, []), nodes(spark, []).selectExpr("node", "node as grp")).first()[0] is None


def test_hubs_are_reported(spark):
    rows = spark.createDataFrame([("t", a) for a in range(5)] + [("t", 0), ("u", 1), ("u", None)], "thread string, actor long")
    assert [tuple(r) for r in graphs.pair_load(rows, ["thread"], "actor", least=2).collect()] == [("t", 5, 10)]
    assert graphs.coparticipation(rows, ["thread"], "actor").count() == 10


def brute_paths(pairs, weight):
    """Betweenness and distances from every shortest path, one by one."""
    import itertools

    nodes_ = sorted({x for p in pairs for x in p})
    length = {frozenset(p): w for p, w in zip(pairs, weight, strict=True)}
    best = {}

    def walk(path, d):
        key = (path[0], path[-1])
        if d < best.get(key, (1e9, []))[0] - 1e-12:
            best[key] = (d, [])
        if abs(d - best.get(key, (d, []))[0]) <= 1e-12:
            best.setdefault(key, (d, []))[1].append(path)
        for v in nodes_:
            if v not in path and frozenset((path[-1], v)) in length:
                walk([*path, v], d + length[frozenset((path[-1], v))])

    for v in nodes_:
        walk([v], 0.0)
    b = dict.fromkeys(nodes_, 0.0)
    for s, t in itertools.combinations(nodes_, 2):
        if (s, t) in best:
            paths = best[(s, t)][1]
            for p in paths:
                for v in p[1:-1]:
                    b[v] += 1 / len(paths)
    n = len(nodes_)
    return {v: 2 * x / ((n - 1) * (n - 2)) for v, x in b.items()}, {k: d for k, (d, _) in best.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_centralities_are_those_of_single_paths(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = [p for p in ((a, b) for a in range(8) for b in range(a)) if rng.random() < 0.35] + [(20, 21)]
    w = [rng.choice((1.0, 2.0, 0.5)) for _ in pairs]
    e = spark.createDataFrame([(a, b, x) for (a, b), x in zip(pairs, w, strict=True)], "src long, dst long, weight double")
    n = nodes(spark, sorted({x for p in pairs for x in p}))
    for weighted in (False, True):
        want, _ = brute_paths(pairs, w if weighted else [1.0] * len(pairs))
        got = {r["node"]: r["betweenness"] for r in kernels.betweenness(n, e, weighted=weighted).collect()}
        assert got == {v: pytest.approx(x, abs=1e-6) for v, x in want.items()}
    _, far = brute_paths(pairs, [1.0] * len(pairs))
    got = {r["node"]: r["harmonic"] for r in kernels.harmonic(n, e).collect()}
    assert got == {v: pytest.approx(sum(1 / d for (s, t), d in far.items() if s == v and t != v) / (len(got) - 1), abs=1e-6) for v in got}


def test_betweenness_of_a_sample_of_sources(spark):
    pairs = [(0, k) for k in range(1, 40)]
    e, n = edges(spark, pairs), nodes(spark, range(40))
    got = {r["node"]: r["betweenness"] for r in kernels.betweenness(n, e, sample=20).collect()}
    assert got[0] == pytest.approx(1.0, abs=0.06) and max(v for k, v in got.items() if k) == 0


@pytest.mark.parametrize("block", [256, 4])
def test_pairs_meet_once_whatever_the_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(graphs, "BLOCK", block)
    rows = spark.createDataFrame([("t", a, a * 10) for a in range(13)] + [("u", a, 1) for a in (2, 5)], "k string, a long, v long")
    got = sorted(tuple(r) for r in graphs.paired(rows, ["k"], "a", "v").collect())
    assert got == sorted([("t", a, b, a * 10, b * 10) for b in range(13) for a in range(b)] + [("u", 2, 5, 1, 1)])


@pytest.mark.parametrize("themes", [10, 150])
def test_stances_as_masks(spark, themes):
    """More themes than a mask has bits, too; a mean of zero is known and agrees with none."""
    import random
    from collections import Counter

    rng = random.Random(themes)
    rows = [(c, a, t, rng.choice((-1.0, -0.5, 0.0, 1.0))) for c in (0, 1) for a in range(9) for t in range(themes) if rng.random() < 0.4]
    m = spark.createDataFrame(rows, "case_id long, actor long, theme long, s double")
    for agree in (True, False):
        weight, shared = Counter(), Counter()
        for c, a, t, s in rows:
            for d, b, u, r in rows:
                if c == d and t == u and a < b:
                    shared[c, a, b] += 1
                    weight[c, a, b] += s * r > 0 if agree else s * r < 0
        want = {(*k, weight[k], shared[k]) for k in shared if weight[k] > 0}
        assert {(r["case_id"], r["src"], r["dst"], r["weight"], r["shared"]) for r in graphs.stance_edges(m, agree).collect()} == want


def test_summaries_of_components_and_concentration(spark):
    e = edges(spark, [(1, 2), (2, 3), (7, 8)])
    r = graphs.components_summary(connected_components(e), nodes(spark, [1, 2, 3, 7, 8, 9])).first()
    assert (r["n_components"], r["giant"], r["giant_ratio"]) == (3, 3, 0.5)
    assert tuple(graphs.components_summary(connected_components(edges(spark, [])), nodes(spark, [])).first())[:2] == (0, 0)
    c = spark.createDataFrame([(k, x) for k, x in enumerate((4.0, 0.0, 0.0, 0.0))], "node long, b double")
    assert tuple(graphs.concentration(c, "b").first()) == (1.0, 4.0, 0.75, 1.0)
    assert graphs.concentration(c.filter("b = 0"), "b").first()["top3_share"] == 0.0


def test_discussion_edges(spark):
    posts = spark.createDataFrame([(1, None, "ann", "Oppose", []), (2, 1, "bob", None, [1]), (3, 2, "ann", "Support", [1, 2]), (4, 1, "bob", "Modify", []), (5, 3, "ann", "Neutral", [])], "post_number int, reply_to_post_number int, author string, stance string, quoted_post_numbers array<int>")
    assert {tuple(r) for r in graphs.reply_edges(posts).collect()} == {("bob", "ann", "reply", "Neutral"), ("ann", "bob", "reply", "Support")}
    assert [tuple(r) for r in graphs.quote_edges(posts).collect()] == [("ann", "bob", "quote", None)]
    t = graphs.thread_edges(posts, "author", "reply_to_post_number").collect()
    assert len(t) == 3 and {r["type"] for r in t} == {"pr_edge"}


def test_elbow_graph_keeps_the_top(spark):
    rows = spark.createDataFrame([(t, a) for a in range(25) for t in range(30 if a < 21 else 2)], "t long, a long")
    got = graphs.elbow_graph(rows, ["t"], "a")
    assert got.count() == 21 * 20 // 2 and got.filter("dst > 20").count() == 0


def test_network_metrics(spark):
    from plenum.operators.reports import network_metrics
    from plenum.sources.files import metric_table

    r = network_metrics(edges(spark, BRIDGE), nodes(spark, range(1, 8)).selectExpr("node", "node <= 3 as grp")).first()
    assert (r["n_nodes"], r["n_edges"], r["n_components"], r["giant_component_ratio"], r["n_louvain_communities"]) == (7, 7, 2, 0.8571, 2)
    assert len(r) == 25 and r["modularity_institution"] == pytest.approx(5 / 14, abs=1e-4)
    assert metric_table(spark.createDataFrame([r]).selectExpr("'a' as case", "*"), "case").count() == 25


def test_layouts(spark):
    from plenum.operators import layout

    n = nodes(spark, range(1, 7))
    pos = {r["node"]: (r["x"], r["y"]) for r in layout.springs(n, edges(spark, BRIDGE), iterations=200).collect()}
    far = lambda a, b: math.dist(pos[a], pos[b])
    assert far(1, 2) < far(1, 5) and far(5, 6) < far(2, 6) and len(pos) == 6
    assert pos == {r["node"]: (r["x"], r["y"]) for r in layout.springs(n, edges(spark, BRIDGE), iterations=200).collect()}
    assert layout.springs(nodes(spark, []), edges(spark, [])).count() == 0
    points = spark.createDataFrame([(0.0, 0.0)] * 2 + [(1.0, 0.0), (-1.0, 0.0), (0.0, 10.0), (0.0, -10.0)], "x double, y double")
    drawn = layout.draw_in(points, q=0.5, factor=1.0).collect()
    assert max(math.hypot(r["x"], r["y"]) for r in drawn) == pytest.approx(1.0)
    assert max(abs(r["y"]) for r in layout.scaled(points, q=1.0, radius=0.6).collect()) == pytest.approx(0.6)
    assert [tuple(r) for r in layout.draw_in(points.filter("x = 0 and y = 0")).collect()] == [(0.0, 0.0)] * 2
    r = layout.ring(n).collect()
    assert all(0.88 <= math.hypot(x["x"], x["y"]) <= 1.08 for x in r) and len({round(x["x"], 3) for x in r}) == 6


def test_core_fit_is_a_correlation(spark):
    g = kernels.adjacency(edges(spark, [(0, i) for i in range(1, 8)] + [(1, 2)]))
    core, fit = kernels.core_fit(g)
    assert kernels.core_correlation(g, core) == pytest.approx(fit) and kernels.core_correlation(g, set(g)) == 0.0


def test_weighted_modularity(spark):
    e = spark.createDataFrame([(1, 2, 3.0), (3, 4, 1.0), (2, 3, 2.0)], "src long, dst long, weight double")
    labels = nodes(spark, range(1, 5)).selectExpr("node", "node <= 2 as label")
    g = kernels.adjacency(e)
    assert graphs.label_modularity(e, labels, weighted=True).first()["q"] == pytest.approx(kernels.modularity(g, {1: 1, 2: 1, 3: 0, 4: 0}), abs=1e-6)
