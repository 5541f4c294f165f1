"""Connected components of an undirected graph by alternating large and small stars.

Every round ends with edges that are written to the shared folder. A round takes two joins on a node,
which Spark can split where a node has very many neighbours; the rounds grow with the logarithm of the
longest path. The graph never comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.storage import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, bare: bool = False) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node with an edge to another.

    Nulls and loops are left out; edges may repeat. An empty graph gives no row. bare: see storage.cut, for edges that come from long loops.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v")))
    e, mark = _written(e.distinct(), bare)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), bare)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _written(e: DataFrame, bare: bool = False) -> tuple[DataFrame, tuple]:
    """The edges, and a mark that tells them from other edges."""
    e = cut(e, bare)
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return e, (r[0], r[1])
