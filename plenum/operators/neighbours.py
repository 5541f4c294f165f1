"""Nearest neighbours of vectors: exact by blocks, and by a forest of random projections that local joins refine.

Vectors become whole numbers, at BITS binary places, so that squared distances are exact: equal vectors are at distance zero, ties
are ties, and a result does not depend on how rows are dealt. All distances here are squares of those.

Exact: points come in waves of bounded size, each broadcast once and held against all rows in matrix products; a task keeps the
first K of each. Its work is the product of the two sides.

Approximate: each tree of the forest parts its nodes at their medians along a random direction, all trees at once and level by
level, until a leaf holds about LEAF points; points on a median are dealt by a hash, so copies of a vector do not stay together.
Leaves are compared whole. Then rounds of local joins: what is in the list of a point, or has it in its own, is compared
with each other, and what is nearer than the last of a list enters it. Lists and leaves are bounded, so a round's work grows with the points.
Vectors go to the joins as bytes, and a task sends the nearest alone of all pairs that its groups have.

Defined cases: rows without an id or a vector take no part; ids are distinct; all vectors are of one length; a point
is not its own neighbour; fewer points than K give lists of all others; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.storage import cut

BITS = 20
#: Numbers in the vectors of a wave, and points of a block of the product.
WAVE, BLOCK = 2_000_000, 512
#: Pairs that a task holds before it drops what is not among the nearest.
PAIRS = 2_000_000
#: Of the forest: trees, points of a leaf, rounds of local joins, and the length of the lists that they work on, as a multiple of K.
TREES, LEAF, ROUNDS, WIDTH, SEED = 8, 64, 4, 3, 42


def points(rows: DataFrame, id_col: str, vector: str, unit: bool = True, bits: int = BITS) -> DataFrame:
    """id and v (whole numbers), written once. unit: vectors are divided by their lengths first."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = F.transform(v, lambda x: F.floor((x / norm if unit else x) * (1 << bits)))
    p = cut(rows.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).filter(norm > 0 if unit else F.lit(True)).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v")))
    r = p.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("m"), F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least")).first()
    if r["m"] is not None and (r["most"] != r["least"] or 4 * r["most"] * r["m"] ** 2 >= 1 << 53):
        raise ValueError("vectors of different lengths, or of components whose squared distances are beyond 53 bits")
    return p


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b; exact, as every sum is a whole number below 2**53."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


def waves(p: DataFrame, size: int | None = None) -> Iterator[tuple[np.ndarray, list]]:
    """The rows of p in parts that fit WAVE numbers: the ids and the rows."""
    r = p.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    parts = max(1, -(-r["n"] * (r["dim"] or 1) // (size or WAVE)))
    for k in range(parts):
        some = p.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).orderBy("id").collect()  # a wave
        if some:
            yield np.array([r["id"] for r in some]), some


def _first(src: np.ndarray, d: np.ndarray, dst: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each src, by d and dst."""
    order = np.lexsort((dst, d, src))
    s = src[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s, "left")
    return order[rank < k]


def _top(ranked: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k)


def exact_neighbours(p: DataFrame, k: int, of: DataFrame | None = None) -> DataFrame:
    """src, dst, d, rank: the k nearest of each point of p, or of each row of `of`, among all of p; written once."""
    parts = []
    for ids, some in waves(p if of is None else of):
        shared = p.sparkSession.sparkContext.broadcast((ids, np.array([r["v"] for r in some], np.float64)))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, vec = shared.value
            held = [np.empty(0, np.int64)] * 3
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, there = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
                found = [held]
                for lo in range(0, len(own), BLOCK):
                    d = squares(vec[lo : lo + BLOCK], there)
                    d[own[lo : lo + BLOCK, None] == ids[None]] = np.inf
                    last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else d.max(1)
                    i, j = np.nonzero((d <= last[:, None]) & (d < np.inf))
                    found.append([own[lo + i], d[i, j].astype(np.int64), ids[j]])
                held = [np.concatenate(x) for x in zip(*found, strict=True)]
                held = [x[_first(held[0], held[1], held[2], k)] for x in held]
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[2]), pa.array(held[1])], names=["src", "dst", "d"])

        parts.append(cut(_top(p.mapInArrow(compare, "src long, dst long, d long"), k)))
        shared.destroy()
    if not parts:
        return p.sparkSession.createDataFrame([], "src long, dst long, d long, rank int")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def forest_leaves(p: DataFrame, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """id, tree, node: the leaf of each point in each tree; written once."""
    r = p.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    levels = max(0, int(np.ceil(np.log2(max(1, r["n"]) / leaf))))
    directions = np.random.default_rng(seed).normal(size=(r["dim"] or 1, trees * max(1, levels)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # A column at a time and in whole steps: equal vectors get equal places, wherever they stand.
                along = np.floor(_matrix(batch.column(1), batch.num_rows) @ directions)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(along), pa.list_(pa.float64()))], names=["id", "along"])

    placed = p.mapInArrow(project, "id long, along array<double>")
    own = F.slice("along", F.col("tree") * max(1, levels) + 1, max(1, levels))
    placed = cut(placed.select("id", "along", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("id", "tree", own.alias("along"), F.lit(0).cast("long").alias("node")))
    for level in range(levels):
        at = F.get("along", F.lit(level))
        middle = placed.groupBy("tree", "node").agg(F.percentile_approx(at, 0.5, 2000).alias("middle"))
        coin = F.pmod(F.xxhash64("id", "tree", F.lit(level)), F.lit(2))
        right = F.when(at == F.col("middle"), coin).otherwise((at > F.col("middle")).cast("long"))
        placed = placed.join(middle, ["tree", "node"]).select("id", "tree", "along", (2 * F.col("node") + right).alias("node"))
        placed = cut(placed) if level % 4 == 3 else placed
    return cut(placed.select("id", "tree", "node"))


def _packed(p: DataFrame) -> DataFrame:
    """p with v as bytes, four a number; written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1), batch.num_rows).astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "v"])

    return cut(p.select("id", "v").mapInArrow(pack, "id long, v binary"))


def _compared(k: int):
    """Rows of ids, packed vectors and radii of a group each: what is nearer than the radius of the first of a pair, the k nearest at most of each that a task
    has found among some PAIRS."""

    def least(found: list[list[np.ndarray]]) -> list[np.ndarray]:
        src, dst, d = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((dst, d, src))
        src, dst, d = src[order], dst[order], d[order]
        new = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])) if len(src) else np.empty(0, bool)
        src, dst, d = src[new], dst[new], d[new]
        near = np.arange(len(src)) - np.searchsorted(src, src, "left") < k
        return [src[near], dst[near], d[near]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[np.empty(0, np.int64)] * 3], 0
        for batch in batches:
            for row in range(batch.num_rows):
                group = batch.column(0)[row].values  # structs of id, v, radius
                ids, n = group.field(0).to_numpy(), len(group)
                radius = group.field(2).to_numpy(zero_copy_only=False)
                v = np.frombuffer(b"".join(group.field(1).to_pylist()), "<i4").astype(np.float64).reshape(n, -1)
                d = squares(v, v)
                d[ids[:, None] == ids[None]] = np.inf
                if n > k + 1:
                    radius = np.minimum(radius, np.partition(d, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero((d <= radius[:, None]) & (d < np.inf))
                held.append([ids[i], ids[j], d[i, j].astype(np.int64)])
                size += len(i)
                if size > PAIRS:
                    held = [least(held)]
                    size = len(held[0][0])
                    if size > PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["src", "dst", "d"])
                        held, size = [[np.empty(0, np.int64)] * 3], 0
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in least(held)], names=["src", "dst", "d"])

    return compare


def _within(groups: DataFrame, k: int) -> DataFrame:
    """groups: key, id, v (packed), radius. The near pairs of each group, which has few rows."""
    rows = groups.groupBy("key").agg(F.collect_list(F.struct("id", "v", "radius")).alias("group"))
    return rows.select("group").mapInArrow(_compared(k), "src long, dst long, d long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src, every pair once; written once, after a single shuffle by src."""
    return cut(_top(found.repartition("src").distinct(), k))


def forest_neighbours(p: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """src, dst, d, rank: nearly the k nearest of each point; written once. The share that is right is measured by recall()."""
    far = F.lit(float("inf"))
    most, k = k, k * width
    leaves, p = forest_leaves(p, trees, leaf, seed), _packed(p)
    leaves = leaves.join(p, "id").select(F.struct("tree", "node").alias("key"), "id", "v", far.alias("radius"))
    best = _merged(_within(leaves, k), k)
    for _ in range(rounds):
        own = best.groupBy("src").agg(F.max("d").alias("last"), F.count("*").alias("n")).select(F.col("src").alias("id"), F.when(F.col("n") < k, far).otherwise(F.col("last").cast("double")).alias("radius"))
        known = p.join(own, "id", "left").select("id", "v", F.coalesce("radius", far).alias("radius"))
        back = best.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("d", "src"))).filter(F.col("place") <= k)
        members = p.select(F.col("id").alias("key"), "id").unionByName(best.select(F.col("src").alias("key"), F.col("dst").alias("id"))).unionByName(back.select(F.col("dst").alias("key"), F.col("src").alias("id"))).distinct()
        found = _within(members.join(known, "id").select("key", "id", "v", "radius"), k)
        now = _merged(found.unionByName(best.select("src", "dst", "d")), k)
        moved = now.join(best, ["src", "dst"], "left_anti").limit(1).count()
        best = now
        if not moved:
            break
    return best.filter(F.col("rank") <= most)


def recall(found: DataFrame, right: DataFrame) -> DataFrame:
    """n (right neighbours), hit (those found) and recall, over the points that right has."""
    f = found.select("src", "dst", F.lit(1).alias("hit"))
    return right.select("src", "dst").join(f, ["src", "dst"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).withColumn("recall", F.col("hit") / F.col("n"))


def membership_weights(found: DataFrame, k: int) -> DataFrame:
    """a < b and weight: how likely an edge is, by the distances beyond each point's nearest and a width that makes its list's weights sum to log2(k);
    the two directions w and x make w + x - w x."""

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column(1)
            count = lists.value_lengths().to_numpy()
            d = np.full((n, k), np.inf)
            row = np.repeat(np.arange(n), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            d[row, place] = np.sqrt(lists.flatten().to_numpy().astype(float))
            nearest = d.min(1)
            beyond = d - nearest[:, None]
            low, high = np.zeros(n), np.full(n, np.inf)
            width = np.maximum(1.0, np.where(np.isfinite(beyond), beyond, 0).max(1))
            for _ in range(64):
                total = np.exp(-beyond / width[:, None]).sum(1)
                over = total > np.log2(k)
                high, low = np.where(over, width, high), np.where(over, low, width)
                width = np.where(np.isinf(high), 2 * width, (low + high) / 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest), pa.array(np.minimum(width, 1e300))], names=["src", "nearest", "width"])

    lists = found.groupBy("src").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # k at most
    w = found.join(lists.mapInArrow(widths, "src long, nearest double, width double"), "src")
    w = w.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.exp(-(F.sqrt("d") - F.col("nearest")) / F.col("width")).alias("w"))
    return w.groupBy("a", "b").agg((F.max("w") + F.when(F.count("*") > 1, F.min("w") * (1 - F.max("w"))).otherwise(0.0)).alias("weight"))
