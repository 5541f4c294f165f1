"""Graph algorithms that need the whole neighbourhood structure: shortest paths, communities, cores.

The edges of one graph are sent to every worker as packed arrays (twelve bytes an edge and end), and the sources of
shortest paths are dealt over the partitions. A graph of more than EDGE_LIMIT edges is refused; components and
degrees (which have no such limit) cut it into parts first. Centralities can be estimated from a seeded
sample of the sources.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.storage import cut, partitions

#: Edges of a graph that is sent to workers (some 200 MB there), and of one whose power iteration runs on the driver.
EDGE_LIMIT, LOCAL_EDGES = 8_000_000, 200_000
#: Numbers of a table of nodes by sources, and of a block of neighbours, that a task holds at once; lengths up to which paths grow by steps of one; cells of a dense block that cost as much as an entry of a list.
HELD, LENGTHS, DENSE = 2_000_000, 32, 30

Graph = dict[int, list[tuple[int, float]]]


def simple_edges(edges: DataFrame) -> pd.DataFrame:
    """a < b and w: parallel edges summed, loops left out, in order; refuses more than EDGE_LIMIT edges."""
    e = edges.filter("src <> dst").groupBy(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    rows = e.limit(EDGE_LIMIT + 1).toArrow().to_pandas()
    if len(rows) > EDGE_LIMIT:
        raise ValueError(f"more than {EDGE_LIMIT} edges")
    return rows.sort_values(["a", "b"], ignore_index=True)


def adjacency(edges: DataFrame) -> Graph:
    """Neighbours by node."""
    g: Graph = defaultdict(list)
    for a, b, w in simple_edges(edges).itertuples(index=False):
        g[a].append((b, w))
        g[b].append((a, w))
    return dict(g)


class Packed:
    """Neighbours of node k (its place in ids) at near[first[k]:first[k + 1]], with the lengths of the edges."""

    def __init__(self, rows: pd.DataFrame, ids: np.ndarray | None = None):
        a, b, w = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), rows["w"].to_numpy(float)
        self.ids = np.union1d(a, b) if ids is None else ids
        at, to, length = np.searchsorted(self.ids, np.concatenate([a, b])), np.searchsorted(self.ids, np.concatenate([b, a])), np.concatenate([w, w])
        order = np.argsort(at, kind="stable")
        self.near, self.length = to[order].astype(np.int32), length[order].astype(np.float64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.ids)))])

    @classmethod
    def of(cls, g: Graph) -> Packed:
        return cls(pd.DataFrame([(a, b, w) for a in sorted(g) for b, w in g[a] if a < b], columns=["a", "b", "w"]))

    def edges_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge of the nodes, in their order: the node, and the edge's place."""
        count = self.first[nodes + 1] - self.first[nodes]
        ends = np.cumsum(count)
        return np.repeat(nodes, count), np.repeat(self.first[nodes] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)

    def layers(self, source: int, length: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Nodes by distance, a layer for each distance that occurs, and all distances (infinite where there is no path)."""
        dist = np.full(len(self.ids), np.inf)
        open_, dist[source] = np.ones(len(self.ids), bool), 0.0
        layers = []
        while True:
            left = np.flatnonzero(open_ & (dist < np.inf))
            if not len(left):
                return layers, dist
            d = dist[left].min()
            own = left[dist[left] <= d + 1e-12]
            open_[own] = False
            layers.append(own)
            node, e = self.edges_of(own)
            np.minimum.at(dist, self.near[e], dist[node] + length[e])

    def dependencies(self, source: int, length: np.ndarray) -> np.ndarray:
        """For each node the share of shortest paths from the source that go through it, summed over their ends."""
        layers, dist = self.layers(source, length)
        n = len(self.ids)
        paths, through = np.zeros(n), np.zeros(n)
        paths[source] = 1.0
        steps = []
        for own in layers[1:]:
            node, e = self.edges_of(own)
            back = np.abs(dist[self.near[e]] + length[e] - dist[node]) <= 1e-12
            node, before = node[back], self.near[e][back]
            paths += np.bincount(node, paths[before], n)
            steps.append((node, before))
        for node, before in reversed(steps):
            through += np.bincount(before, paths[before] / paths[node] * (1 + through[node]), n)
        through[source] = 0.0
        return through


class Stepped:
    """A graph whose lengths are small whole numbers, for many sources at once: level d of the paths is made of the levels before it, a product of neighbours and a
    table of nodes by sources for each length. Rows of many neighbours are multiplied as dense blocks, those of few as sums over lists."""

    def __init__(self, rows: pd.DataFrame):
        g = Packed(rows)
        self.ids, self.steps = g.ids, []
        node = np.repeat(np.arange(len(g.ids)), np.diff(g.first))
        for w in np.unique(g.length):
            own = g.length == w
            self.steps.append((int(w), node[own].astype(np.int32), g.near[own]))
        self.width = max(1, min(256, HELD // max(1, len(g.ids))))

    @staticmethod
    def fits(rows: pd.DataFrame) -> bool:
        w = rows["w"].to_numpy(float)
        return bool(((w >= 1) & (w <= LENGTHS) & (w == np.floor(w))).all())

    def times(self, step: int, x: np.ndarray, want: np.ndarray | None = None) -> np.ndarray:
        """For each node, or those marked, the sum of x over its neighbours at that length."""
        _, node, near = self.steps[step]
        has, out = x.any(1), np.zeros(x.shape)
        keep = has[near] if want is None else has[near] & want[node]
        node, near = node[keep], near[keep]
        rows, start = np.unique(node, return_index=True)
        first, cols = np.append(start, len(node)), np.flatnonzero(has)
        dense = DENSE * len(near) > len(rows) * len(cols)
        place, some = np.cumsum(has) - 1, x[cols]
        lo = 0
        while lo < len(rows):
            hi = min(len(rows), lo + max(1, 4 * HELD // len(cols))) if dense else max(lo + 1, int(np.searchsorted(first, first[lo] + 4 * HELD // x.shape[1], "right")) - 1)
            e = slice(first[lo], first[hi])
            if dense:
                block = np.zeros((hi - lo, len(cols)))
                block[np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1])), place[near[e]]] = 1.0
                out[rows[lo:hi]] = block @ some
            else:
                out[rows[lo:hi]] = np.add.reduceat(x[near[e]], first[lo:hi] - first[lo], axis=0)
            lo = hi
        return out

    def paths(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from the sources (a column each; -1 where there is no path) and the numbers of shortest paths."""
        n, cols = len(self.ids), np.arange(len(sources))
        dist, paths = np.full((n, len(cols)), -1, np.int32), np.zeros((n, len(cols)))
        dist[sources, cols], paths[sources, cols] = 0, 1.0
        d = last = 0
        longest = max(w for w, _, _ in self.steps)
        while d < last + longest and (dist < 0).any():
            d += 1
            found = np.zeros_like(paths)
            left = (dist < 0).any(1)
            for k, (w, _, _) in enumerate(self.steps):
                if d >= w and (at := dist == d - w).any():
                    found += self.times(k, np.where(at, paths, 0.0), left)
            new = (found > 0) & (dist < 0)
            if new.any():
                dist[new], paths[new], last = d, found[new], d
        return dist, paths

    def dependencies(self, sources: np.ndarray) -> np.ndarray:
        """For each node the share of shortest paths from the sources that go through it, summed over their ends."""
        dist, paths = self.paths(sources)
        through = np.zeros_like(paths)
        for d in range(int(dist.max()) - 1, 0, -1):
            back, own = np.zeros_like(paths), dist == d
            for k, (w, _, _) in enumerate(self.steps):
                if (at := dist == d + w).any():
                    back += self.times(k, np.divide(1 + through, paths, out=np.zeros_like(paths), where=at), own.any(1))
            through[own] = (back * paths)[own]
        return through.sum(1)

    def inverse_distances(self, sources: np.ndarray) -> np.ndarray:
        """For each source the sum of inverse distances, by levels in their order."""
        dist, out = self.paths(sources)[0], np.zeros(len(sources))
        for d in range(1, int(dist.max(initial=0)) + 1):
            out += (dist == d).sum(0) / d
        return out


def _sources(nodes: DataFrame, sample: int | None, seed: int) -> tuple[DataFrame, DataFrame, int, float]:
    """The nodes, those to start from, the number of nodes, and what a start stands for."""
    own = cut(nodes.select(F.col("node").cast("long").alias("node")).distinct())
    n, parts = own.count(), partitions(nodes.sparkSession)
    # By number, as few rows would else be one task's, however long each takes.
    if sample is None or sample >= n:
        return own, own.repartition(parts, "node"), n, 1.0
    return own, own.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(sample).repartition(parts, "node"), n, n / sample


def shortest_only(rows: pd.DataFrame, roots: int = 4) -> pd.DataFrame:
    """rows without edges that are longer than the way between their ends by one of the roots, the nodes of most edges: no shortest path has them."""
    if rows.empty:
        return rows
    g = Packed(rows)
    a, b, w = np.searchsorted(g.ids, rows["a"].to_numpy()), np.searchsorted(g.ids, rows["b"].to_numpy()), rows["w"].to_numpy(float)
    keep = np.ones(len(rows), bool)
    for r in np.argsort(-np.diff(g.first), kind="stable")[:roots]:
        dist = g.layers(int(r), g.length)[1]
        keep &= ~(w > (dist[a] + dist[b]) * (1 + 1e-9) + 1e-9)
    return rows[keep].reset_index(drop=True)


def betweenness(nodes: DataFrame, edges: DataFrame, weighted: bool = False, inverse: bool = False, sample: int | None = None, seed: int = 42) -> DataFrame:
    """node and betweenness (normalised, undirected). weighted: weights are distances; inverse: their inverses are.

    sample: an estimate from so many sources, drawn by a seeded hash; its standard error falls with the root of their number.
    """
    rows = simple_edges(edges)
    rows["w"] = 1 / rows["w"] if inverse else rows["w"] if weighted else 1.0
    rows = shortest_only(rows) if weighted or inverse else rows
    stepped = Stepped.fits(rows)
    shared = nodes.sparkSession.sparkContext.broadcast(Stepped(rows) if stepped else Packed(rows))  # at most EDGE_LIMIT edges
    own, starts, n, stands_for = _sources(nodes, sample, seed)

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        total = np.zeros(len(g.ids))
        for batch in batches:
            starts = np.flatnonzero(np.isin(g.ids, batch["node"].to_numpy()))
            if stepped:
                for lo in range(0, len(starts), g.width):
                    total += g.dependencies(starts[lo : lo + g.width])
            else:
                for k in starts:
                    total += g.dependencies(int(k), g.length)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"node": g.ids[some], "b": total[some]})

    part = starts.mapInPandas(accumulate, "node long, b double").groupBy("node").agg(F.sum("b").alias("b"))
    scale = stands_for / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return own.join(part, "node", "left").select("node", F.round(F.coalesce("b", F.lit(0.0)) * scale, 6).alias("betweenness"))


def harmonic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and harmonic: the mean inverse distance to all other nodes."""
    shared = nodes.sparkSession.sparkContext.broadcast(Stepped(simple_edges(edges).assign(w=1.0)))  # at most EDGE_LIMIT edges
    _, starts, n, _ = _sources(nodes, None, 0)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for batch in batches:
            ids = batch["node"].to_numpy()
            out = np.zeros(len(ids))
            known = np.flatnonzero(np.isin(ids, g.ids))
            for lo in range(0, len(known), g.width):
                some = known[lo : lo + g.width]
                out[some] = g.inverse_distances(np.searchsorted(g.ids, ids[some])) / max(1, n - 1)
            yield pd.DataFrame({"node": ids, "harmonic": out})

    return starts.mapInPandas(reach, "node long, harmonic double").withColumn("harmonic", F.round("harmonic", 6))


#: Sources whose reach a task follows at once, and rows of which it gathers the bits at once.
FOLLOWED, GATHERED = 1024, 200_000


class Shared:
    """Who took part in what, for distances in the graph of those who share a thread: a step goes from actors to their threads and back, and the graph's edges are never made. Sources are bits."""

    def __init__(self, thread: np.ndarray, actor: np.ndarray):
        at, size = np.unique(thread, return_inverse=True, return_counts=True)[1:]
        some = size[at] > 1
        at = np.unique(at[some], return_inverse=True)[1]
        self.ids, who = np.unique(actor[some], return_inverse=True)
        self.ways = []
        for key, other in ((at, who), (who, at)):
            order = np.argsort(key, kind="stable")
            self.ways.append((other[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(key))])))

    def spread(self, way: int, bits: np.ndarray) -> np.ndarray:
        """The bits of all members of each thread, or of all threads of each actor."""
        near, first = self.ways[way]
        out, lo = np.empty((len(first) - 1, bits.shape[1]), np.uint64), 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + GATHERED, "right")) - 1)
            out[lo:hi] = np.bitwise_or.reduceat(bits[near[first[lo] : first[hi]]], first[lo:hi] - first[lo], axis=0)
            lo = hi
        return out

    def inverse_distances(self, sources: np.ndarray) -> np.ndarray:
        """For each source the sum of inverse distances, by levels in their order."""
        width = -(-len(sources) // 64)
        bits, out = np.zeros((len(self.ids), 8 * width), np.uint8), np.zeros(len(sources))
        bits[sources, np.arange(len(sources)) // 8] = 1 << (np.arange(len(sources)) % 8)
        seen = now = bits.view(np.uint64)
        d = 0
        while now.any():
            d += 1
            now = self.spread(1, self.spread(0, now)) & ~seen
            seen = seen | now
            for lo in range(0, len(now), 8192):
                out_of = np.unpackbits(now[lo : lo + 8192].view(np.uint8), axis=1, bitorder="little")[:, : len(sources)].sum(0)
                count = out_of if lo == 0 else count + out_of
            out += count / d
        return out


def shared_harmonic(rows: DataFrame, thread: list[str], actor: str, nodes: DataFrame | None = None) -> DataFrame:
    """harmonic of the graph that coparticipation makes of the rows, for the nodes or, without them, those with an edge. Actors are whole numbers. The rows, eight bytes each and way, are sent to every worker, and no edge is made."""
    spark = rows.sparkSession
    t = cut(rows.select(*thread, F.col(actor).cast("long").alias("_a")).dropna().distinct())
    names = cut(t.select(*thread).distinct().withColumn("_t", F.monotonically_increasing_id()))
    got = t.join(names, thread).select("_t", "_a").toArrow()
    g = Shared(got.column("_t").to_numpy(), got.column("_a").to_numpy())
    own = None if nodes is None else cut(nodes.select(F.col("node").cast("long").alias("node")).distinct())
    n, parts = len(g.ids) if own is None else own.count(), partitions(spark)
    step = min(FOLLOWED, 64 * max(1, -(-len(g.ids) // (64 * parts))))
    blocks = -(-len(g.ids) // step)
    shared = spark.sparkContext.broadcast(g)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for batch in batches:
            for k in batch["id"].tolist():
                some = np.arange(k * step, min(len(g.ids), (k + 1) * step))
                yield pd.DataFrame({"node": g.ids[some], "harmonic": g.inverse_distances(some) / max(1, n - 1)})

    found = spark.range(0, blocks, 1, max(1, blocks)).mapInPandas(reach, "node long, harmonic double").withColumn("harmonic", F.round("harmonic", 6))
    return found if own is None else own.join(found, "node", "left").select("node", F.coalesce("harmonic", F.lit(0.0)).alias("harmonic"))


def eigenvector(edges: DataFrame, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """node and eigenvector: power iteration of x <- (A + I) x, L2 norm 1. Beyond LOCAL_EDGES it goes over edge tables, a step being a join and a sum, with the same test after each step."""
    if edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return _eigenvector_local(edges, max_iter, tol)
    w = edges.select("src", "dst", F.lit(1.0).alias("w"))
    both = cut(w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).distinct())
    x = cut(both.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    n = x.count()
    if not n:
        return x.withColumnRenamed("x", "eigenvector")
    x = x.withColumn("x", F.lit(1 / math.sqrt(n)))
    for _ in range(max_iter):
        pull = both.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("y"))
        y = x.join(pull, "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("y"))
        y = cut(y)
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        x = y.select("node", (F.col("y") / norm).alias("x"), "old")
        if x.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] < n * tol:
            break
        x = x.select("node", "x")
    return x.select("node", F.round("x", 6).alias("eigenvector"))


def _eigenvector_local(edges: DataFrame, max_iter: int, tol: float) -> DataFrame:
    g = Packed(simple_edges(edges))
    n = len(g.ids)
    node = np.repeat(np.arange(n), np.diff(g.first))
    x = np.full(n, 1 / math.sqrt(max(1, n)))
    for _ in range(max_iter):
        y = x + np.bincount(node, x[g.near], n)
        y /= np.linalg.norm(y) or 1.0
        gap, x = np.abs(y - x).sum(), y
        if gap < n * tol:
            break
    return edges.sparkSession.createDataFrame(pd.DataFrame({"node": g.ids, "eigenvector": np.round(x, 6)}), "node long, eigenvector double")


def modularity(g: Graph, community: dict[int, int]) -> float:
    p = Packed.of(g)
    return _modularity(p, np.array([community[v] for v in p.ids.tolist()], np.int64))


def _modularity(g: Packed, community: np.ndarray) -> float:
    m2 = g.length.sum()
    if not m2:
        return 0.0
    at = np.unique(community, return_inverse=True)[1]
    node = np.repeat(np.arange(len(g.ids)), np.diff(g.first))
    total, same = np.bincount(at[node], g.length), at[node] == at[g.near]
    return float((np.bincount(at[node[same]], g.length[same], len(total)) / m2 - (total / m2) ** 2).sum())


def louvain(g: Graph, seed: int = 42) -> dict[int, int]:
    """Communities that no move of a node, then of a community, improves."""
    p = Packed.of(g)
    return dict(zip(p.ids.tolist(), _louvain(p, seed).tolist(), strict=True))


def _louvain(g: Packed, seed: int) -> np.ndarray:
    """The community of each node, named by one of its nodes."""
    rng = random.Random(seed)
    names, where = g.ids, np.arange(len(g.ids))
    first, near, length = g.first, g.near.astype(np.int64), g.length
    loops, m2 = np.zeros(len(names)), g.length.sum()
    while m2:
        n = len(names)
        node = np.repeat(np.arange(n), np.diff(first))
        com, k = np.arange(n), np.bincount(node, length, n) + loops
        tot, moved, improved = k.copy(), True, False
        order = list(range(n))
        rng.shuffle(order)
        while moved:
            moved = False
            for v in order:
                e = slice(first[v], first[v + 1])
                found, at = np.unique(com[near[e]], return_inverse=True)
                links, own = np.bincount(at, length[e], len(found)), com[v]
                tot[own] -= k[v]
                here = np.searchsorted(found, own)
                stay = (links[here] if here < len(found) and found[here] == own else 0.0) - tot[own] * k[v] / m2
                gain = links - tot[found] * k[v] / m2
                best = found[gain.argmax()] if len(found) and gain.max() > stay + 1e-12 else own
                tot[best] += k[v]
                com[v] = best
                if best != own:
                    moved = improved = True
        if not improved:
            break
        kept, at = np.unique(com, return_inverse=True)
        where, names = at[where], names[kept]
        src, dst, c = at[node], at[near], len(kept)
        loops = np.bincount(at, loops, c) + np.bincount(src[src == dst], length[src == dst], c)
        pair, which = np.unique((src * c + dst)[src != dst], return_inverse=True)
        length = np.bincount(which, length[src != dst], len(pair))
        first, near = np.concatenate([[0], np.cumsum(np.bincount(pair // c, minlength=c))]), pair % c
    return names[where]


def communities(edges: DataFrame, seed: int = 42) -> tuple[DataFrame, float]:
    """node and community, and the modularity of the partition."""
    g = Packed(simple_edges(edges))
    found = _louvain(g, seed)
    return edges.sparkSession.createDataFrame(pd.DataFrame({"node": g.ids, "community": found}), "node long, community long"), _modularity(g, found)


def core_fit(g: Graph, rounds: int | None = None) -> tuple[set[int], float]:
    """A core that no single change improves, and the correlation with the ideal pattern (core with all, periphery with core only)."""
    p = Packed.of(g)
    core, best = _core_fit(p, rounds)
    return set(p.ids[core].tolist()), best


def _fit(n: int, m: float, size, hit):
    """The correlation of a core of that size that touches hit of the m edges among n nodes; 0 where a side does not vary. Of arrays, too."""
    pairs = n * (n - 1) / 2
    a, b = m / pairs, (size * (size - 1) / 2 + size * (n - size)) / pairs
    spread = np.sqrt(np.maximum(a * (1 - a) * b * (1 - b), 0.0))
    return np.where(spread > 1e-12, (hit / pairs - a * b) / np.where(spread > 1e-12, spread, 1.0), 0.0)


def _core_fit(g: Packed, rounds: int | None = None) -> tuple[np.ndarray, float]:
    """The core as a mark for each node, and its correlation. Rounds go on until no single change helps, or for so many at most; each change raises the fit, so they end."""
    n, m = len(g.ids), len(g.near) / 2
    degree = np.diff(g.first)
    core = np.zeros(n, bool)
    core[np.lexsort((g.ids, -degree))[: max(1, n // 5)]] = True
    pairs = n * (n - 1) / 2

    def fit(size: int, hit: float) -> float:
        ideal = size * (size - 1) / 2 + size * (n - size)
        a, b = m / pairs, ideal / pairs
        spread = math.sqrt(a * (1 - a) * b * (1 - b))
        return (hit / pairs - a * b) / spread if spread > 1e-12 else 0.0

    node = np.repeat(np.arange(n), degree)
    size, hit = int(core.sum()), float((core[node] | core[g.near]).sum() / 2)
    outside = np.bincount(node[~core[g.near]], minlength=n)
    best = fit(size, hit)
    done = 0
    while rounds is None or done < rounds:
        changed, done = False, done + 1
        for v in range(n):
            sign = -1 if core[v] else 1
            if 0 < size + sign < n and (q := fit(size + sign, hit + sign * int(outside[v]))) > best + 1e-12:
                core[v] = not core[v]
                size, hit, best, changed = size + sign, hit + sign * int(outside[v]), q, True
                outside[g.near[g.first[v] : g.first[v + 1]]] -= sign
        if not changed:
            break
    return core, best


def core_changes(g: Packed, core: np.ndarray) -> tuple[float, float]:
    """The correlation of a core, and the best one after a change of a single node, from the edges that the cores touch."""
    n, m, size = len(g.ids), len(g.near) / 2, int(core.sum())
    node = np.repeat(np.arange(n), np.diff(g.first))
    hit = (core[node] | core[g.near]).sum() / 2
    sign = np.where(core, -1, 1)
    after = _fit(n, m, size + sign, hit + sign * np.bincount(node[~core[g.near]], minlength=n))
    allowed = (size + sign > 0) & (size + sign < n)
    return float(_fit(n, m, size, hit)), float(after[allowed].max(initial=-1.0))


def core_correlation(g: Graph, core: set[int]) -> float:
    """The correlation over all pairs of nodes of having an edge with having an end in the core; 0 where either does not vary."""
    nodes = sorted(g)
    near = {v: {w for w, _ in g[v]} for v in nodes}
    edge = np.array([b in near[a] for i, a in enumerate(nodes) for b in nodes[i + 1 :]], float)
    ideal = np.array([a in core or b in core for i, a in enumerate(nodes) for b in nodes[i + 1 :]], float)
    spread = edge.std() * ideal.std()
    return float(((edge - edge.mean()) * (ideal - ideal.mean())).mean() / spread) if spread > 1e-12 else 0.0


def core_periphery(edges: DataFrame, nulls: int | None = None, seed: int = 42) -> DataFrame:
    """One row: core size, its mean degree, fit, and the share of random graphs of as many edges that fit as well: 100 of them, or 20 for graphs of over 200 nodes. The random graphs are dealt over the partitions."""
    spark = edges.sparkSession
    g = Packed(simple_edges(edges))
    n, m = len(g.ids), len(g.near) // 2
    nulls = nulls or (20 if n > 200 else 100)
    core, best = _core_fit(g) if n > 2 else (np.ones(n, bool), 0.0)

    def random_fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"].tolist():
                rng, codes = np.random.default_rng([seed, k]), np.empty(0, np.int64)
                while len(codes) < m:  # pairs in the order of their first draw
                    a, b = rng.integers(0, n, (2, m + 16))
                    codes = np.concatenate([codes, (np.minimum(a, b) * n + np.maximum(a, b))[a != b]])
                    codes = codes[np.sort(np.unique(codes, return_index=True)[1])]
                a, b = np.divmod(codes[:m], n)
                out.append(_core_fit(Packed(pd.DataFrame({"a": a, "b": b, "w": 1.0}), np.arange(n)))[1])
            yield pd.DataFrame({"fit": out})

    draws = spark.range(0, nulls if n > 2 else 0, 1, nulls).mapInPandas(random_fits, "fit double")
    degree = round(float(np.diff(g.first)[core].sum()) / max(1, int(core.sum())), 4)
    return draws.agg(F.lit(int(core.sum())).cast("long").alias("core_size"), F.lit(degree).alias("core_degree"), F.lit(round(best, 6)).alias("fit"), F.round((F.count_if(F.col("fit") >= best) + 1) / (F.count("*") + 1), 6).alias("p_value"))
