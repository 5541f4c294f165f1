"""Places of nodes for drawing: springs, outliers drawn in, and a ring for what is not connected."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.graphs import within
from plenum.operators.kernels import simple_edges

#: Nodes of a drawing. Every two repel each other, so that the work grows with the square of their number.
DRAWN = 5_000


def springs(nodes: DataFrame, edges: DataFrame, iterations: int = 150, k: float | None = None, seed: int = 42) -> DataFrame:
    """node, x and y: nodes repel each other and edges pull, with steps that shrink; at most DRAWN nodes.

    A step is at most 0.1 long at first and 0.92 times as long in each next round. Parallel edges pull once.
    """
    rows = nodes.select(F.col("node").cast("long")).distinct().orderBy("node").limit(DRAWN + 1).collect()
    if len(rows) > DRAWN:
        raise ValueError(f"more than {DRAWN} nodes to draw")
    ids = np.array([r[0] for r in rows], np.int64)
    e = simple_edges(within(edges, nodes))
    e = e[e["a"].isin(ids) & e["b"].isin(ids)]
    a, b = np.searchsorted(ids, e["a"].to_numpy(np.int64)), np.searchsorted(ids, e["b"].to_numpy(np.int64))
    pos = np.random.default_rng(seed).uniform(-1, 1, (len(ids), 2))
    k = k or (math.sqrt(1 / len(ids)) if len(ids) else 1.0)
    longest = 0.1
    for _ in range(iterations):
        move = np.zeros_like(pos)
        for lo in range(0, len(ids), 512):
            gap = pos[lo : lo + 512, None] - pos[None]
            far = np.maximum(np.hypot(gap[..., 0], gap[..., 1]), 0.001)
            move[lo : lo + 512] = (gap * (k * k / far**2)[..., None]).sum(1)
        gap = pos[a] - pos[b]
        pull = gap * (np.maximum(np.hypot(gap[:, 0], gap[:, 1]), 0.001) / k)[:, None]
        np.subtract.at(move, a, pull)
        np.add.at(move, b, pull)
        step = np.hypot(move[:, 0], move[:, 1])
        some = step > 0
        pos[some] += move[some] * (np.minimum(step, longest) / np.where(some, step, 1))[some, None]
        longest = max(longest * 0.92, 0.001)
    return nodes.sparkSession.createDataFrame(pd.DataFrame({"node": ids, "x": pos[:, 0], "y": pos[:, 1]}), "node long, x double, y double")


def _centred(points: DataFrame, x: str, y: str, q: float) -> DataFrame:
    """points with _cx, _cy (the centre), _d (how far each is from it) and _r (the q-th quantile of that; 1 if it is 0)."""
    centre = points.agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    d = points.crossJoin(F.broadcast(centre)).withColumn("_d", F.hypot(F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")))  # one row
    r = d.agg(F.percentile("_d", q).alias("_r"))
    return d.crossJoin(F.broadcast(r)).withColumn("_r", F.when(F.coalesce("_r", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_r")))  # one row


def draw_in(points: DataFrame, x: str = "x", y: str = "y", q: float = 0.95, factor: float = 0.42) -> DataFrame:
    """Points farther from the centre than the q-th quantile are put at that distance; then all are drawn towards the centre by factor."""
    d = _centred(points, x, y, q)
    scale = F.when(F.col("_d") > F.col("_r"), F.col("_r") / F.col("_d")).otherwise(1.0) * factor
    return d.withColumn(x, F.col("_cx") + (F.col(x) - F.col("_cx")) * scale).withColumn(y, F.col("_cy") + (F.col(y) - F.col("_cy")) * scale).drop("_cx", "_cy", "_d", "_r")


def scaled(points: DataFrame, x: str = "x", y: str = "y", q: float = 0.8, radius: float = 0.6) -> DataFrame:
    """Points around 0, so that the q-th quantile of their distances is radius."""
    d = _centred(points, x, y, q)
    return d.withColumn(x, (F.col(x) - F.col("_cx")) * (radius / F.col("_r"))).withColumn(y, (F.col(y) - F.col("_cy")) * (radius / F.col("_r"))).drop("_cx", "_cy", "_d", "_r")


def ring(nodes: DataFrame, node: str = "node", inner: float = 0.88, depth: float = 0.2, turn: float = 0.1, seed: int = 42) -> DataFrame:
    """nodes with x and y around a circle in the order of their ids, moved by a seeded hash by up to turn (radians) and depth (outwards)."""
    share = lambda salt: F.pmod(F.xxhash64(F.col(node), F.lit(seed), F.lit(salt)), F.lit(1 << 32)) / float(1 << 32)
    n = nodes.withColumn("_i", F.row_number().over(Window.orderBy(node)) - 1).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("_n"))))  # the nodes of a drawing
    theta, r = 2 * math.pi * F.col("_i") / F.col("_n") + (2 * share("turn") - 1) * turn, F.lit(inner) + share("depth") * depth
    return n.withColumn("x", r * F.cos(theta)).withColumn("y", r * F.sin(theta)).drop("_i", "_n")
