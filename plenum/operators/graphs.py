"""Graph construction and set-based graph metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.inequality import gini
from plenum.storage import cut

#: Actors of a thread that meet in one task; a larger thread is dealt into blocks, of which each pair is a task's.
BLOCK = 256
#: Rows of a block of actors, of which each pair is a cell; blocks at least; meetings that a task counts at once.
CELL, BLOCKS, MEETINGS = 500_000, 4, 2_000_000
#: Rows that a task packs at once.
PACK = 1 << 18


def paired(rows: DataFrame, keys: list[str], actor: str, *values: str) -> DataFrame:
    """keys, src < dst, and the values of both as v_a and v_b: every pair of actors that share the keys, which rows have once each.

    Keys with more than BLOCK actors are parted: an actor goes to each cell of its block and another, and two of one block
    meet in the cell of that block alone. The rows are written first, as they are read up to four times.
    """
    rows = cut(rows)

    def side(df: DataFrame, name: str, mark: str) -> DataFrame:
        return df.select(*keys, *[c for c in ("_lo", "_hi") if c in df.columns], F.col(actor).alias(name), *[F.col(v).alias(f"{v}_{mark}") for v in values], *([F.col("_own").alias(f"_own_{mark}")] if "_own" in df.columns else []))

    out = [*keys, "src", "dst", *[f"{v}_{m}" for v in values for m in "ab"]]
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    if hot.isEmpty():
        return side(rows, "src", "a").join(side(rows, "dst", "b"), keys).filter("src < dst").select(out)
    parts = cut(hot.select(*keys, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_parts")))
    dealt = rows.join(parts, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(actor), F.col("_parts")).cast("int"))
    cells = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_lo", F.least("_own", "_o")).withColumn("_hi", F.greatest("_own", "_o"))
    met = side(cells, "src", "a").join(side(cells, "dst", "b"), [*keys, "_lo", "_hi"])
    return met.filter((F.col("src") < F.col("dst")) & ((F.col("_own_a") != F.col("_own_b")) | (F.col("_lo") == F.col("_hi")))).select(out)


def shared_sums(rows: DataFrame, keys: list[str], actor: str, value: str) -> DataFrame:
    """src < dst, weight (the sum of products of the values) and n_shared (keys that both have), of rows that have (keys, actor) once each; actors are whole numbers.

    Actors are dealt into blocks, and each pair of blocks is a cell. A cell has all rows of its actors, so what two actors share is counted there, some of
    the actors at a time, and no pair is shuffled: what is written are the rows, once for each block, packed.
    """
    return _dealt(rows, keys, actor, value).mapInArrow(partial(_met, "products", 1, False), "_g long, src long, dst long, weight long, n_shared long").drop("_g")


def shared_stances(rows: DataFrame, apart: list[str], item: str, actor: str, sign: str, agree: bool | None, least: int = 1) -> DataFrame:
    """apart, src < dst, weight (items on which both have the same sign, or opposite ones where agree is False) and n_shared (items that both have, least at
    least), of pairs with any weight, counted as in shared_sums. agree of None: signs do not matter, and weight is n_shared. apart: keys of few values, such as cases."""
    groups = cut(rows.select(*apart).dropna().distinct().withColumn("_g", F.monotonically_increasing_id()))
    how = "items" if agree is None else "agree" if agree else "oppose"
    found = _dealt(rows.join(F.broadcast(groups), apart), ["_g", item], actor, sign, "_g").mapInArrow(partial(_met, how, least, False), "_g long, src long, dst long, weight long, n_shared long")
    kind = dict(rows.dtypes)[actor]
    return found.join(F.broadcast(groups), "_g").select(*apart, *[F.col(c).cast(kind).alias(c) for c in ("src", "dst")], "weight", "n_shared")  # a row for each case


def shared_degrees(rows: DataFrame, thread: list[str], actor: str) -> DataFrame:
    """node, degree and strength in the graph that coparticipation makes of the rows, of nodes with an edge; actors are whole numbers. Pairs are counted in their cells and do not leave them."""
    t = rows.select(*thread, F.col(actor).alias("a"), F.lit(1).alias("one")).filter(F.col("a").isNotNull()).distinct()
    found = _dealt(t, thread, "a", "one").mapInArrow(partial(_met, "products", 1, True), "node long, degree long, strength long")
    return found.groupBy(F.col("node").cast(dict(t.dtypes)["a"]).alias("node")).agg(F.sum("degree").alias("degree"), F.sum("strength").alias("strength"))


def shared_labels(rows: DataFrame, thread: list[str], actor: str, label: str) -> DataFrame:
    """node, label, degree and inside (neighbours of its own label) in the graph that coparticipation makes of the rows, of nodes with an edge. Actors and labels are whole numbers, and a
    label is the actor's on all its rows. Pairs are counted in their cells and do not leave them."""
    t = rows.select(*thread, F.col(actor).alias("a"), F.col(label).alias("l")).dropna(subset=["a"]).distinct()
    found = _dealt(t, thread, "a", "l").mapInArrow(partial(_met, "labels", 1, True), "node long, degree long, inside long, label long")
    return found.groupBy(F.col("node").cast(dict(t.dtypes)["a"]).alias("node"), F.col("label").cast(dict(t.dtypes)["l"]).alias("label")).agg(F.sum("degree").alias("degree"), F.sum("inside").alias("inside"))


def _dealt(rows: DataFrame, keys: list[str], actor: str, value: str, group: str | None = None) -> DataFrame:
    """_g, _lo, _hi, _own and rows in packs: each pack goes to the cells of its block and any other, of one group."""
    names = cut(rows.select(*keys).dropna().distinct().withColumn("_t", F.monotonically_increasing_id()))
    own = rows.filter(F.col(actor).isNotNull()).join(names, keys)
    own = cut(own.select((F.col(group) if group else F.lit(0)).cast("long").alias("_g"), "_t", F.col(actor).cast("long").alias("_a"), F.col(value).cast("long").alias("_v")))
    n = max(BLOCKS, -(-own.count() // CELL))
    packs = own.withColumn("_own", F.pmod(F.xxhash64("_a"), F.lit(n)).cast("int")).mapInArrow(_packed, "_g long, _own int, rows binary")
    cells = packs.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_lo", F.least("_own", "_o")).withColumn("_hi", F.greatest("_own", "_o")).drop("_o")
    return cells.repartition(2 * n * (n + 1), "_g", "_lo", "_hi").sortWithinPartitions("_g", "_lo", "_hi")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_t, _a, _v) by group and block, as bytes: of each column the low halves of the numbers and then the high ones, which compress well."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        g, t, a, v, own = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((t, a, own, g))
        g, t, a, v, own = (x[order] for x in (g, t, a, v, own))
        ends = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(own) != 0)) + 1), len(g)]
        for lo, hi in zip(ends, ends[1:], strict=False):
            pack = b"".join(c[lo:hi].astype("<i8").view("<i4").reshape(-1, 2).T.tobytes() for c in (t, a, v))
            yield pa.RecordBatch.from_arrays([pa.array([g[lo]], pa.int64()), pa.array([own[lo]], pa.int32()), pa.array([pack], pa.binary())], ["_g", "_own", "rows"])

    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_t", "_a", "_v", "_own")])
        size += len(batch)
        if size >= PACK:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def _met(how: str, least: int, ends: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is counted of whole cells one after the other, with their group."""
    held: list[list[np.ndarray]] = []
    at = None

    def out() -> Iterator[pa.RecordBatch]:
        for b in _counted(held, at[1] if at else None, how, least, ends):
            yield b if ends else pa.RecordBatch.from_arrays([pa.array(np.full(len(b), at[0])), *b.columns], ["_g", *b.schema.names])

    for batch in batches:
        for g, lo, hi, own, pack in zip(*[batch.column(c) for c in ("_g", "_lo", "_hi", "_own", "rows")], strict=True):
            cell = (g.as_py(), lo.as_py() << 32 | hi.as_py())
            if cell != at:
                yield from out()
                held, at = [], cell
            columns = np.frombuffer(pack.as_buffer(), "<i4").reshape(3, 2, -1)
            t, a, v = (np.ascontiguousarray(c.T).view("<i8").ravel() for c in columns)
            held.append([t, a, v, np.full(len(t), own.as_py())])
    yield from out()


def _counted(held: list[list[np.ndarray]], cell: int | None, how: str = "products", least: int = 1, ends: bool = False) -> Iterator[pa.RecordBatch]:
    """src, dst, weight and n_shared of a cell's pairs; ends: node, degree and strength instead. how tells weight: the sum of products, or the items with equal signs, with opposite ones, or all.
    how of labels: with ends, node, degree, neighbours of equal value, and the value."""
    if not held:
        return
    labels, how = how == "labels", "items" if how == "labels" else how
    t, a, v, own = (np.concatenate(x) for x in zip(*held, strict=True))
    low, high = own == cell >> 32, own == cell & 0xFFFFFFFF
    kinds, t = np.unique(t, return_inverse=True)
    a_ids, a_at = np.unique(a[low], return_inverse=True)
    b_ids, b_at = np.unique(a[high], return_inverse=True)
    order = np.argsort(a_at, kind="stable")
    a_t, a_at, a_v = t[low][order], a_at[order], v[low][order]
    order = np.argsort(t[high], kind="stable")
    b_t, b_at, b_v = t[high][order], b_at[order], v[high][order]
    if not len(a_at) or not len(b_at):
        return
    start = np.searchsorted(b_t, a_t)
    count = np.searchsorted(b_t, a_t, "right") - start
    first = np.searchsorted(a_at, np.arange(len(a_ids) + 1))  # an actor's rows
    met = np.concatenate([[0], np.cumsum(count)])[first]
    width = len(b_ids)
    # Where actors share much, as products of matrices of actors by threads.
    dense = len(kinds) * width <= 4 * MEETINGS and 50 * met[-1] > len(a_ids) * width * len(kinds)
    if dense:
        known = np.zeros((len(kinds), width))
        values = np.zeros((len(kinds), width))
        known[b_t, b_at], values[b_t, b_at] = 1.0, b_v
        values = {"products": values, "items": known}.get(how) if how in ("products", "items") else np.concatenate([values > 0, values < 0][:: 1 if how == "agree" else -1]).astype(float)
    of_a, of_b = np.zeros((2, len(a_ids)), np.int64), np.zeros((2, width), np.int64)
    own_a, own_b = np.zeros(len(a_ids), np.int64), np.zeros(width, np.int64)
    own_a[a_at], own_b[b_at] = a_v, b_v
    lo = 0
    while lo < len(a_ids):
        most = max(1, MEETINGS // width)
        hi = min(lo + most, len(a_ids)) if dense else max(lo + 1, int(np.searchsorted(met, met[lo] + MEETINGS, "right")) - 1)
        rows = slice(first[lo], first[hi])
        if dense:
            some, sums = np.zeros((hi - lo, len(kinds))), np.zeros((hi - lo, len(kinds)))
            some[a_at[rows] - lo, a_t[rows]], sums[a_at[rows] - lo, a_t[rows]] = 1.0, a_v[rows]
            shared = (some @ known).ravel()
            pair = np.flatnonzero(shared >= least)
            left = {"products": sums, "items": some}[how] if how in ("products", "items") else np.concatenate([sums > 0, sums < 0], 1).astype(float)
            shared, weight = shared[pair], (left @ values).ravel()[pair]
        else:
            n = count[rows]
            b = np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            key = np.repeat(a_at[rows] - lo, n) * width + b_at[b]
            if labels:  # who meets is enough
                del b
                if (hi - lo) * width <= 4 * max(len(key), 1):
                    mark = np.zeros((hi - lo) * width, bool)
                    mark[key] = True
                    pair = np.flatnonzero(mark)
                else:
                    key.sort()
                    pair = key[np.append(True, np.diff(key) > 0)[: len(key)]]
            elif (hi - lo) * width <= 4 * max(len(key), 1):
                pair, which = None, key
            else:
                pair, which = np.unique(key, return_inverse=True)
            shared = np.bincount(which) if not labels else np.ones(len(pair))
            product = np.repeat(a_v[rows], n) if not labels else None
            if least > 1:  # most pairs share less: their items need no look
                many = shared[which] >= least
                which, product, b = which[many], product[many], b[many]
            if not labels:
                product = product * b_v[b] if how != "items" else np.ones(len(b))
                product = product if how in ("products", "items") else product > 0 if how == "agree" else product < 0
                weight = np.bincount(which, product, len(shared))
                some = np.flatnonzero(shared >= least)
                shared, weight, pair = shared[some], weight[some], some if pair is None else pair[some]
        x, y = a_ids[pair // width + lo], b_ids[pair % width]
        good = x < y if cell >> 32 == cell & 0xFFFFFFFF else np.ones(len(x), bool)
        if how in ("agree", "oppose"):
            good &= weight > 0
        if labels:
            weight = (own_a[pair // width + lo] == own_b[pair % width]).astype(float)
        if ends:
            for sums, end in ((of_a, pair // width + lo), (of_b, pair % width)):
                sums[0] += np.bincount(end[good], minlength=sums.shape[1])
                sums[1] += np.bincount(end[good], weight[good], sums.shape[1]).astype(np.int64)
            lo = hi
            continue
        lo = hi
        out = [np.minimum(x, y)[good], np.maximum(x, y)[good], weight[good].astype(np.int64), shared[good].astype(np.int64)]
        for k in range(0, len(out[0]), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 18)]) for c in out], ["src", "dst", "weight", "n_shared"])
    if ends:
        ids, (degree, strength) = np.concatenate([a_ids, b_ids]), np.concatenate([of_a, of_b], 1)
        out = {"node": ids, "degree": degree, "inside" if labels else "strength": strength} | ({"label": np.concatenate([own_a, own_b])} if labels else {})
        yield pa.RecordBatch.from_arrays([pa.array(c[degree > 0]) for c in out.values()], list(out))


def _whole(df: DataFrame, *columns: str) -> bool:
    return all(dict(df.dtypes)[c] in ("bigint", "int", "smallint", "tinyint") for c in columns)


def coparticipation(rows: DataFrame, thread: list[str], actor: str) -> DataFrame:
    """src < dst and weight: threads that two actors share. A thread's actors are made distinct before they meet."""
    t = rows.select(*thread, F.col(actor).alias("a")).filter(F.col("a").isNotNull()).distinct()
    if _whole(t, "a"):
        kind = dict(t.dtypes)["a"]
        return shared_sums(t.withColumn("one", F.lit(1)), thread, "a", "one").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.col("n_shared").alias("weight"))
    return paired(t, thread, "a").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def thread_links(rows: DataFrame, thread: list[str], actor: str) -> DataFrame:
    """src < dst: each thread's least actor with the others. These edges have the nodes and the components of coparticipation's, and are no more than the rows."""
    t = rows.select(*thread, F.col(actor).alias("dst")).dropna()
    least = t.groupBy(*thread).agg(F.min("dst").alias("src"))
    return t.join(least, thread).filter("src < dst").select("src", "dst").distinct()


def elbow_graph(rows: DataFrame, thread: list[str], actor: str) -> DataFrame:
    """coparticipation of the actors with the most rows, down to the elbow of their counts."""
    from plenum.operators.timebins import elbow_cutoff

    counts = rows.filter(F.col(actor).isNotNull()).groupBy(actor).agg(F.count("*").alias("_n"))
    cutoff = elbow_cutoff(counts, "_n", actor).first()["cutoff"]
    top = counts.orderBy(F.desc("_n"), actor).limit(cutoff).select(actor)  # at most the cap of the elbow
    return coparticipation(rows.join(F.broadcast(top), actor, "left_semi"), thread, actor)


def pair_load(rows: DataFrame, thread: list[str], actor: str, least: int = 1000) -> DataFrame:
    """Threads with at least so many actors, and the pairs that coparticipation makes of each: what to look at before hubs explode."""
    n = rows.filter(F.col(actor).isNotNull()).groupBy(*thread).agg(F.countDistinct(actor).alias("actors")).filter(F.col("actors") >= least)
    return n.withColumn("pairs", (F.col("actors") * (F.col("actors") - 1) / 2).cast("long"))


def mean_stance(rows: DataFrame, keys: list[str] = ["case_id"]) -> DataFrame:  # noqa: B006
    return rows.groupBy(*keys, "actor", "theme").agg(F.avg("stance").alias("s"))


def stance_edges(means: DataFrame, agree: bool, min_shared: int = 1) -> DataFrame:
    """Edges of actors with mean stances of one sign (or of opposite signs) on themes: weight, and the themes known to both.

    Pairs of actors that are whole numbers are counted in cells. Of others, an actor's themes are bits of masks (63 themes to a mask), so that two actors meet once for all of them.
    """
    if _whole(means, "actor"):
        signs = means.filter(F.col("s").isNotNull()).withColumn("_s", F.when(F.col("s") > 0, 1).when(F.col("s") < 0, -1).otherwise(0))
        return shared_stances(signs, ["case_id"], "theme", "actor", "_s", agree, min_shared).withColumnRenamed("n_shared", "shared")
    themes = cut(means.select("theme").distinct())
    number = themes.select("theme", (F.row_number().over(Window.orderBy("theme")) - 1).alias("_k"))  # a row for each theme of a codebook
    bit = F.expr("shiftleft(1L, CAST(_k % 63 AS INT))")
    own = means.filter(F.col("s").isNotNull() & F.col("actor").isNotNull()).join(F.broadcast(number), "theme").groupBy("case_id", F.floor(F.col("_k") / 63).alias("_mask"), "actor").agg(
        F.coalesce(F.bit_or(F.when(F.col("s") > 0, bit)), F.lit(0)).alias("yes"), F.coalesce(F.bit_or(F.when(F.col("s") < 0, bit)), F.lit(0)).alias("no"), F.bit_or(bit).alias("known"))
    pairs = paired(own, ["case_id", "_mask"], "actor", "yes", "no", "known")
    both = lambda x, y: F.col(x).bitwiseAND(F.col(y))
    weight = both("yes_a", "yes_b").bitwiseOR(both("no_a", "no_b")) if agree else both("yes_a", "no_b").bitwiseOR(both("no_a", "yes_b"))
    e = pairs.select("case_id", "src", "dst", F.bit_count(weight).cast("long").alias("weight"), F.bit_count(both("known_a", "known_b")).cast("long").alias("shared"))
    if themes.count() > 63:
        e = e.groupBy("case_id", "src", "dst").agg(F.sum("weight").alias("weight"), F.sum("shared").alias("shared"))
    return e.filter((F.col("weight") > 0) & (F.col("shared") >= min_shared))


def projection(counts: DataFrame, node: str, over: str, n: str) -> DataFrame:
    """src < dst, weight (the sum of products of counts) and n_shared: what two nodes share of the other side."""
    if _whole(counts, node, n):
        kind = dict(counts.dtypes)[node]
        return shared_sums(counts, [over], node, n).withColumns({c: F.col(c).cast(kind) for c in ("src", "dst")})
    return paired(counts, [over], node, n).groupBy("src", "dst").agg(F.sum(F.col(f"{n}_a") * F.col(f"{n}_b")).alias("weight"), F.count("*").alias("n_shared"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (parallel edges count each) and strength."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def within(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select(F.col(node)).distinct()
    return edges.join(n.withColumnRenamed(node, "src"), "src", "left_semi").join(n.withColumnRenamed(node, "dst"), "dst", "left_semi")


def degree_metrics(edges: DataFrame | None, nodes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """found: the degrees, where they are known. One row: nodes, edges, mean degree (3 places), the population deviation around it over n - 1, maximum, share of the three largest, density, isolates."""
    found = degrees(edges) if found is None else found
    d = cut(nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")))  # read three times
    base = d.agg(F.count("*").alias("n"), F.sum("degree").alias("m2"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 3).alias("mean_degree"), F.count_if(F.expr("degree = 0")).alias("isolates"))
    top = d.orderBy(F.desc("degree"), "node").limit(3).agg(F.sum("degree").alias("top3"))
    dev = d.crossJoin(F.broadcast(base.select("mean_degree"))).agg(F.sqrt(F.avg(F.pow(F.col("degree") - F.col("mean_degree"), F.lit(2)))).alias("std"))  # one row
    one = base.crossJoin(top).crossJoin(dev)
    return one.select(
        "n", (F.col("m2") / 2).cast("long").alias("m"), "mean_degree", F.round(F.col("std") / F.nullif(F.col("n") - 1, F.lit(0)), 6).alias("centralisation"), "max_degree",
        F.round(F.try_divide(F.col("top3"), F.col("m2")), 6).alias("top3_share"), F.round(F.try_divide(F.col("m2").cast("double"), F.col("n") * (F.col("n") - 1)), 6).alias("density"), "isolates",
    )


def label_modularity(edges: DataFrame, labels: DataFrame, weighted: bool = False) -> DataFrame:
    """One row, q: modularity of the labels (node, label), every edge counted once, or by its weight."""
    w = F.col("weight") if weighted else F.lit(1)
    m = edges.agg(F.sum(w).alias("m"))
    j = edges.withColumn("_w", w).join(labels.select(F.col("node").alias("src"), F.col("label").alias("la")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("lb")), "dst")
    inside = j.filter("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("_w").alias("inside"))
    both = j.select(F.explode(F.array("la", "lb")).alias("label"), "_w").groupBy("label").agg(F.sum("_w").alias("d"))
    part = both.join(inside, "label", "left").crossJoin(F.broadcast(m))  # one row
    q = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))
    return part.agg(F.round(F.sum(q), 6).alias("q"))


def counted_modularity(found: DataFrame) -> DataFrame:
    """label_modularity of what shared_labels counted."""
    part = found.groupBy("label").agg(F.sum("degree").alias("d"), (F.sum("inside") / 2).alias("inside"))
    q = F.col("inside") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))
    return part.crossJoin(F.broadcast(part.agg((F.sum("d") / 2).alias("m")))).agg(F.round(F.sum(q), 6).alias("q"))  # one row


def counted_crossing(found: DataFrame) -> DataFrame:
    """crossing_share of what shared_labels counted."""
    return found.agg(F.round(F.try_divide(F.sum("degree") - F.sum("inside"), F.sum("degree")), 6).alias("cross_share"))


def crossing_share(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row, cross_share: edges between different groups (node, grp; Unknown where there is none); null without edges."""
    g = groups.select("node", F.col("grp").cast("string").alias("grp"))
    j = edges.join(g.select(F.col("node").alias("src"), F.col("grp").alias("ga")), "src", "left").join(g.select(F.col("node").alias("dst"), F.col("grp").alias("gb")), "dst", "left")
    unknown = F.lit("Unknown")
    return j.agg(F.round(F.avg((F.coalesce("ga", unknown) != F.coalesce("gb", unknown)).cast("int")), 6).alias("cross_share"))


def first_per_pair(edges: DataFrame, pos: str, *columns: str) -> DataFrame:
    """One row for each (src, dst), that of the least pos."""
    w = Window.partitionBy("src", "dst").orderBy(pos)
    return edges.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("src", "dst", *columns)


def top_subgraph(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the k nodes of the largest strength."""
    top = degrees(edges).orderBy(F.desc("strength"), "node").limit(k)
    return within(edges, top)


def components_summary(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: the number of components of the nodes (isolates too), the largest one's size, and its share of them. components: node and component, of nodes with edges."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    s = sizes.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("in_one"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    n = nodes.agg(F.count_distinct("node").alias("n"))
    j = s.crossJoin(n)  # one row each
    giant = F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.col("most"), F.lit(1)))
    return j.select((F.col("c") + F.col("n") - F.col("in_one")).alias("n_components"), giant.cast("long").alias("giant"), F.round(F.try_divide(giant, F.col("n")), 4).alias("giant_ratio"))


def concentration(centrality: DataFrame, value: str) -> DataFrame:
    """One row: mean, max, Gini and the share of the three largest of a node value (0 where all are 0)."""
    base = centrality.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.sum(value).alias("sum"))
    top = centrality.orderBy(F.desc(value)).limit(3).agg(F.sum(value).alias("top"))
    one = base.crossJoin(top).crossJoin(gini(centrality, value))  # one row each
    return one.select(F.round("mean", 6).alias("mean"), F.round("max", 5).alias("max"), F.round("gini", 4).alias("gini"), F.round(F.when(F.col("sum") > 0, F.col("top") / F.col("sum")).otherwise(0.0), 4).alias("top3_share"))


def reply_edges(posts: DataFrame, author: str = "author", number: str = "post_number", to: str = "reply_to_post_number", stance: str = "stance", keys: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, type and stance: one edge for each ordered pair of authors, with the stance of the first reply (Neutral where it has none). Replies to oneself give none. keys: what posts are numbered within."""
    p = posts.select(*keys, F.col(number).alias("_n"), F.col(to).alias("_to"), F.col(author).alias("src"), F.coalesce(stance, F.lit("Neutral")).alias("stance"))
    target = p.select(*keys, F.col("_n").alias("_to"), F.col("src").alias("dst"))
    j = p.join(target, [*keys, "_to"]).filter("src <> dst").withColumn("_pos", F.struct(*keys, "_n"))
    return first_per_pair(j, "_pos", "stance").select("src", "dst", F.lit("reply").alias("type"), "stance")


def quote_edges(posts: DataFrame, author: str = "author", number: str = "post_number", quoted: str = "quoted_post_numbers", keys: tuple[str, ...] = ()) -> DataFrame:
    """src < dst, type and stance (none): one edge for each unordered pair of authors of whom one quotes the other."""
    p = posts.select(*keys, F.col(author).alias("_a"), F.explode(quoted).alias("_q"))
    target = posts.select(*keys, F.col(number).alias("_q"), F.col(author).alias("_b"))
    pairs = p.join(target, [*keys, "_q"]).filter("_a <> _b").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).distinct()
    return pairs.select("src", "dst", F.lit("quote").alias("type"), F.lit(None).cast("string").alias("stance"))


def thread_edges(rows: DataFrame, author: str, thread: str, prefix: str = "PR_") -> DataFrame:
    """src, dst, type and stance (none): one edge from each author to the node of each thread that it took part in."""
    t = rows.filter(F.col(thread).isNotNull() & F.col(author).isNotNull()).select(F.col(author).alias("src"), F.concat(F.lit(prefix), F.col(thread).cast("string")).alias("dst")).distinct()
    return t.select("src", "dst", F.lit("pr_edge").alias("type"), F.lit(None).cast("string").alias("stance"))
