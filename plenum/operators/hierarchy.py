"""Clusters by density at every scale: a spanning tree of mutual reachability, its hierarchy, and the clusters of it that last longest.

Two points reach each other at the largest of their distance and the distances to the MIN_SAMPLES-th neighbour of either. The spanning tree grows by
rounds in which each component takes its least edge to another. Lists of neighbours give most of them: what a point's list
does not hold is beyond its last entry. A component whose best listed edge is not proven by that looks for a lesser one
from the points in question, held against all rows in blocks, so the tree is the exact one.

The hierarchy is made of the tree without putting its edges in one order. An edge that is the least of neither of its
ends has components on both sides; all others are contracted, which leaves at most half of the edges, and so on until none
is left. An edge belongs to the first contracted node below whose least edge it lies, the edges of such a node
make a chain by weight, and the chain hangs from that least edge. Sizes are running sums along chains. So every step is a
join or an aggregate, and their number grows with the logarithm of the points.

What parts into two sides of MIN_SIZE points ends a cluster and starts two, smaller sides fall out of it. Clusters are chosen by the
excess of mass, of which the driver holds a row a cluster, CLUSTERS at most.

Distances are squares of whole numbers (see neighbours), and edges are in order by (weight, ids), so the result has no ties. A
distance of zero counts as one unit in densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum import storage
from plenum.operators.components import connected_components
from plenum.operators.neighbours import BLOCK, _matrix, squares, waves
from plenum.storage import partitions

MIN_SIZE, MIN_SAMPLES = 10, 5
#: Clusters of the hierarchy, before the choice, that the driver chooses from: 100 MB of them.
CLUSTERS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    return storage.cut(df, bare=True)


def core_distances(found: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """id, core: the distance to the min_samples-th neighbour, or to the last where there are fewer."""
    return found.filter(F.col("rank") <= min_samples).groupBy("src").agg(F.max("d").alias("core")).withColumnRenamed("src", "id")


def _least(comp: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
    """The least (w, a, b) of each comp."""
    order = np.lexsort((b, a, w, comp))
    order = order[np.concatenate([[True], comp[order][1:] != comp[order][:-1]])] if len(order) else order
    return [x[order] for x in (comp, w, a, b, to)]


def _searched(known: DataFrame, open_points: DataFrame) -> DataFrame:
    """comp, w, a, b, to: the least edges of components from their open points to points of others; a row for each component, wave and task at most.
    known: id, v, core, comp."""
    parts = []
    for ids, some in waves(open_points):
        shared = known.sparkSession.sparkContext.broadcast((ids, np.array([r["v"] for r in some], np.float64), np.array([r["core"] for r in some], np.float64), np.array([r["comp"] for r in some])))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, vec, core, comp = shared.value
            held = [np.empty(0, np.int64)] * 5
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, there, cores, comps = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows), batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy()
                for lo in range(0, len(own), BLOCK):
                    at = slice(lo, lo + BLOCK)
                    w = np.maximum(np.maximum(squares(vec[at], there), core[at, None]), cores[None])
                    w[comp[at, None] == comps[None]] = np.inf
                    least = w.min(1)
                    kinds, kind = np.unique(comp[at], return_inverse=True)
                    of_kind = np.full(len(kinds), np.inf)
                    np.minimum.at(of_kind, kind, least)
                    rows = np.flatnonzero((least == of_kind[kind]) & (least < np.inf))
                    i, j = np.nonzero(w[rows] == least[rows, None])
                    i = rows[i]
                    x, y = own[lo + i], ids[j]
                    held = _least(*[np.concatenate(z) for z in zip(held, [comp[lo + i], w[i, j].astype(np.int64), np.minimum(x, y), np.maximum(x, y), comps[j]], strict=True)])
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["comp", "w", "a", "b", "to"])

        parts.append(cut(known.mapInArrow(search, "comp long, w long, a long, b long, to long")))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def spanning_tree(p: DataFrame, found: DataFrame, core: DataFrame, exact: bool = True) -> DataFrame:
    """a < b and w: the least spanning tree of mutual reachability; written once. p: id, v; found: lists of neighbours.
    exact: every edge is proven; else a component without a listed edge looks for one, but for the largest such."""
    spark, n = p.sparkSession, p.count()
    own = cut(p.join(core, "id", "left").na.fill(0, ["core"]))
    listed = found.groupBy("src").agg(F.max("d").alias("last"), F.count("*").alias("n")).withColumnRenamed("src", "id")
    # Beyond the end of its list a point has no edge; a list of all others has no end.
    beyond = cut(own.join(listed, "id", "left").select("id", F.when(F.coalesce("n", F.lit(0)) < n - 1, F.greatest("core", F.coalesce("last", F.lit(0)))).alias("beyond")))
    ends = [own.select(F.col("id").alias(x), F.col("core").alias(f"core_{x}")) for x in "ab"]
    pairs = found.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "d").distinct()
    edges = cut(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w")))
    labels = cut(own.select("id", F.col("id").alias("comp")))
    tree: list[DataFrame] = []
    while True:
        sizes = labels.groupBy("comp").agg(F.count("*").alias("n"))
        largest = sizes.orderBy(F.desc("n"), "comp").limit(2).collect()
        if len(largest) < 2:
            break
        sides = [labels.select(F.col("id").alias(x), F.col("comp").alias(y)) for x, y in (("a", "comp"), ("b", "to"))]
        edges = cut(edges.select("a", "b", "w").join(sides[0], "a").join(sides[1], "b").filter("comp <> to"))
        both = edges.unionByName(edges.select("a", "b", "w", F.col("to").alias("comp"), F.col("comp").alias("to")))
        key = F.min(F.struct("w", "a", "b", "to")).alias("e")
        best = cut(both.groupBy("comp").agg(key))
        state = labels.join(best.select("comp", F.col("e.w").alias("best")), "comp", "left").join(beyond, "id")
        if exact:
            state = state.filter(F.col("beyond").isNotNull() & (F.col("best").isNull() | (F.col("beyond") <= F.col("best"))))
        else:
            alone = sizes.join(best, "comp", "left_anti").orderBy(F.desc("n"), "comp").limit(1).collect()
            state = state.filter(F.col("best").isNull() & (F.col("comp") != (alone[0]["comp"] if alone and alone[0]["n"] == largest[0]["n"] else -1)))
        open_points = cut(own.join(state.select("id", "comp"), "id"))
        if not open_points.isEmpty():
            more = _searched(cut(own.join(labels, "id")).select("id", "v", "core", "comp"), open_points)
            best = cut(best.select("comp", "e.*").unionByName(more).groupBy("comp").agg(key))
        chosen = best.select("comp", "e.*")
        tree.append(chosen.select("a", "b", "w").distinct())
        joined = connected_components(chosen.select(F.col("comp").alias("src"), F.col("to").alias("dst")), bare=True)
        labels = cut(labels.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")))
    return cut(reduce(DataFrame.unionByName, tree)) if tree else spark.createDataFrame([], "a long, b long, w long")


def running(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """rows with the sums of value up to each row of its group: summed in ranges, so that no task takes a group whole. Each order is one row's."""
    placed = cut(rows.withColumn("_value", value).repartitionByRange(partitions(rows.sparkSession), *keys, order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy(order))
    return placed.join(before, [*keys, "_range"]).withColumn(name, F.col("_before") + within).drop("_value", "_range", "_before")


def chains(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chain (level, vertex) of each edge e = (w, a, b), and the edge that each chain hangs from; at level 0 a vertex is a point, without a chain."""
    now = cut(tree.select(F.struct("w", "a", "b").alias("e"), F.col("a").alias("u"), F.col("b").alias("v")))
    waiting, placed, hangs, level = None, [], [], 0
    while True:
        least = cut(now.select("e", F.explode(F.array("u", "v")).alias("vertex")).groupBy("vertex").agg(F.min("e").alias("least")))
        hangs.append(least.select(F.lit(level).alias("level"), "vertex", F.col("least").alias("e")))
        if waiting is not None:
            w = waiting.join(least, "vertex", "left")
            below = F.col("least").isNull() | (F.col("e") < F.col("least"))
            placed.append(cut(w.filter(below).select(F.lit(level).alias("level"), "vertex", "e")))
            waiting = w.filter(~below).select("vertex", "e")
        if now.isEmpty():
            break
        light = now.join(least.select(F.col("least").alias("e")).distinct(), "e", "left_semi")
        to = cut(connected_components(light.select(F.col("u").alias("src"), F.col("v").alias("dst")), bare=True))
        name = lambda x, y, to=to: to.select(F.col("node").alias(x), F.col("component").alias(y))
        kept = light.select("e", F.col("u").alias("vertex"))
        kept = kept if waiting is None else kept.unionByName(waiting.select("e", "vertex"))
        waiting = cut(kept.join(name("vertex", "up"), "vertex").select("e", F.col("up").alias("vertex")))
        heavy = now.join(light.select("e"), "e", "left_anti")
        now = cut(heavy.join(name("u", "x"), "u").join(name("v", "y"), "v").select("e", F.col("x").alias("u"), F.col("y").alias("v")))
        level += 1
    none = tree.sparkSession.createDataFrame([], "level int, vertex long, e struct<w: bigint, a: bigint, b: bigint>")
    return cut(reduce(DataFrame.unionByName, placed, none)), cut(reduce(DataFrame.unionByName, hangs))


def _segment(n: Column | str) -> Column:
    return F.concat_ws("_", "level", "vertex", n).alias("segment")


def hierarchy(tree: DataFrame, min_size: int = MIN_SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: of edges (e, level, vertex, size, more and less: the points on its two sides, splits up to it in its chain, segment), of chains
    (level, vertex, e that it hangs from, total: its edges and those below, splits), and of points (id, e)."""
    edges, hangs = chains(tree)
    points = hangs.filter("level = 0").select(F.col("vertex").alias("id"), "e")
    where = edges.select("e", F.col("level").alias("up_level"), F.col("vertex").alias("up_vertex"))
    links = cut(hangs.filter("level > 0").join(where, "e"))
    counted = cut(edges.groupBy("level", "vertex").agg(F.count("*").alias("own")))
    totals = counted.limit(0).select("level", "vertex", F.col("own").alias("total"))
    for level in [r["level"] for r in counted.select("level").distinct().orderBy("level").collect()]:  # a row a level
        below = links.filter(F.col("up_level") == level).join(totals, ["level", "vertex"]).groupBy(F.col("up_vertex").alias("vertex")).agg(F.sum("total").alias("below"))
        own = counted.filter(F.col("level") == level).join(below, "vertex", "left")
        totals = cut(totals.unionByName(own.select("level", "vertex", (F.col("own") + F.coalesce("below", F.lit(0))).alias("total"))))
    hung = links.join(totals, ["level", "vertex"]).groupBy("e").agg(F.sum("total").alias("hang"), F.max("total").alias("most"), F.count("*").alias("hung"))
    rows = edges.join(hung, "e", "left").na.fill(0, ["hang", "most", "hung"])
    rows = running(rows, ["level", "vertex"], "e", 1 + F.col("hang"), "size").withColumn("size", F.col("size") + 1)
    # An edge with two chains is the first of its own; else its sides are what is below it in its chain, and what hangs from it.
    one = F.when(F.col("hung") == 2, 1 + F.col("most")).otherwise(F.col("size") - 1 - F.col("hang"))
    rows = rows.withColumn("more", F.greatest(one, F.col("size") - one)).withColumn("less", F.least(one, F.col("size") - one))
    split = (F.col("less") >= min_size).cast("int")
    rows = cut(running(rows, ["level", "vertex"], "e", split, "splits").select("e", "level", "vertex", "size", "more", "less", "hung", "splits", _segment("splits")))
    last = rows.groupBy("level", "vertex").agg(F.max("splits").alias("splits"))
    chain = cut(totals.join(last, ["level", "vertex"]).join(links.select("level", "vertex", "e"), ["level", "vertex"], "left"))
    return rows, chain, points


def density(w: Column | str) -> Column:
    return 1 / F.sqrt(F.greatest(F.col(w) if isinstance(w, str) else w, F.lit(1)))


def condensed(rows: DataFrame, chain: DataFrame, min_size: int = MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, parent, birth, stability, size) and the cluster of each segment of a chain; written once."""
    big, split = F.col("size") >= min_size, F.col("less") >= min_size
    tops = chain.filter((F.col("total") + 1 >= min_size) & F.col("e").isNotNull()).select(_segment("splits").alias("child"), "e")
    up = tops.join(rows.select("e", "segment", split.alias("split"), F.col("e.w").alias("w")), "e")
    joined = connected_components(up.filter("not split").select(F.col("child").alias("src"), F.col("segment").alias("dst")), bare=True)
    segments = rows.filter(big).select("segment").distinct().join(joined.withColumnRenamed("node", "segment"), "segment", "left")
    segments = cut(segments.select("segment", F.coalesce("component", "segment").alias("cluster")))
    leave = F.when(~split & (F.col("more") >= min_size), F.col("less")).otherwise(F.col("size"))
    mass = rows.filter(big).join(segments, "segment").groupBy("cluster").agg(F.sum(leave * density("e.w")).alias("mass"), F.max("size").alias("size"))
    beneath = rows.filter(split & (F.col("hung") < 2)).select(_segment(F.col("splits") - 1).alias("child"), "segment", F.col("e.w").alias("w"))
    starts = up.filter("split").select("child", "segment", "w").unionByName(beneath)
    starts = starts.join(segments.withColumnRenamed("cluster", "parent"), "segment").join(segments.select(F.col("segment").alias("child"), "cluster"), "child").select("cluster", "parent", density("w").alias("birth"))
    found = mass.join(starts, "cluster", "left").withColumn("birth", F.coalesce("birth", F.lit(0.0)))
    return cut(found.select("cluster", "parent", "birth", (F.col("mass") - F.col("birth") * F.col("size")).alias("stability"), "size")), segments


def excess_of_mass(clusters: list) -> dict[str, str]:
    """The chosen cluster of each that lies in one: those of more stability than all that are chosen beneath; never the root."""
    beneath: dict[str, list[str]] = {r["cluster"]: [] for r in clusters}
    roots = [r["cluster"] for r in clusters if r["parent"] is None]
    for r in clusters:
        if r["parent"] is not None:
            beneath[r["parent"]].append(r["cluster"])
    order = list(roots)
    for c in order:
        order.extend(beneath[c])
    worth, chosen = {r["cluster"]: r["stability"] for r in clusters}, set()
    for c in reversed(order):
        under = sum(worth[x] for x in beneath[c])
        if beneath[c] and (under > worth[c] or c in roots):
            worth[c] = under
        else:
            chosen.add(c)
    found: dict[str, str] = {}
    parent = {r["cluster"]: r["parent"] for r in clusters}
    for c in order:
        if parent[c] in found:
            found[c] = found[parent[c]]
        elif c in chosen and c not in roots:
            found[c] = c
    return found


def cluster_labels(tree: DataFrame, ids: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """id and topic of every row of ids: topics are numbered by size, then by their least id; others are noise, -1."""
    spark = tree.sparkSession
    rows, chain, points = hierarchy(tree, min_size)
    clusters, segments = condensed(rows, chain, min_size)
    listed = clusters.limit(CLUSTERS + 1).collect()  # a row a cluster
    if len(listed) > CLUSTERS:
        raise ValueError(f"more than {CLUSTERS} clusters in the hierarchy")
    chosen = spark.createDataFrame(list(excess_of_mass(listed).items()), "cluster string, chosen string")
    # A point is in the cluster of the first edge above it that has min_size points below.
    totals = chain.select("level", "vertex", "total", F.col("e").alias("up"))
    parts, open_points = [], points
    while not open_points.isEmpty():
        at = open_points.join(rows.select("e", "level", "vertex", "size", "segment"), "e").join(totals, ["level", "vertex"])
        at = cut(at.withColumn("segment", F.when(F.col("size") >= min_size, F.col("segment")).when(F.col("total") + 1 >= min_size, _segment(F.lit(0)))))
        parts.append(at.filter(F.col("segment").isNotNull()).select("id", "segment"))
        open_points = at.filter(F.col("segment").isNull() & F.col("up").isNotNull()).select("id", F.col("up").alias("e"))
    if not parts:
        return ids.select("id", F.lit(-1).cast("long").alias("topic"))
    own = cut(reduce(DataFrame.unionByName, parts).join(segments, "segment").join(chosen, "cluster").select("id", "chosen"))
    sizes = own.groupBy("chosen").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    number = sizes.select("chosen", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long").alias("topic"))  # a row a topic
    return ids.select("id").join(own.join(number, "chosen").select("id", "topic"), "id", "left").select("id", F.coalesce("topic", F.lit(-1)).cast("long").alias("topic"))
