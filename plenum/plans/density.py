"""Queries: neighbours of embeddings, the spanning tree of their mutual reachability, and topics by its hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import hierarchy, neighbours
from plenum.plans.registry import query
from plenum.storage import table

#: Neighbours in a list, as wide as a topic model's graph has them.
NEAR = 15

_UNIT = f"p AS MATERIALIZED (SELECT vec_id AS id, list_transform(v, lambda x: floor(x / n * {1 << neighbours.BITS})) AS v FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)) WHERE n > 0)"
_SQUARE = "CAST(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v) AS BIGINT)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"WITH {_UNIT}, d AS (SELECT a.id AS src, b.id AS dst, {_SQUARE} AS d FROM p a JOIN p b ON a.id <> b.id WHERE a.id % 20 = 0) SELECT * FROM (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM d) WHERE rank <= {NEAR}")
def nearest_vectors(spark, sf_dir):
    """The nearest of all vectors to those whose id is divisible by 20."""
    p = _points(spark, sf_dir)
    return neighbours.exact_neighbours(p, NEAR, p.filter("id % 20 = 0")).withColumn("rank", F.col("rank").cast("long"))


@query()
def neighbour_recall(spark, sf_dir):
    """How many of those the forest's lists hold."""
    p = _points(spark, sf_dir)
    return neighbours.recall(neighbours.forest_neighbours(p, NEAR), neighbours.exact_neighbours(p, NEAR, p.filter("id % 20 = 0")))


@query()
def neighbour_weights(spark, sf_dir):
    """The graph of the forest's lists, weighted by likelihood."""
    return neighbours.membership_weights(neighbours.forest_neighbours(_points(spark, sf_dir), NEAR), NEAR).withColumn("weight", F.round("weight", 6))


#: The tree grown from one point: each step takes the least edge that leaves it.
_TREE = f"""WITH RECURSIVE {_UNIT}, d AS MATERIALIZED (SELECT a.id AS u, b.id AS v, {_SQUARE} AS d FROM p a JOIN p b ON a.id <> b.id),
  c AS (SELECT u AS id, max(d) AS core FROM (SELECT u, d, row_number() OVER (PARTITION BY u ORDER BY d) AS i FROM d) WHERE i <= {hierarchy.MIN_SAMPLES} GROUP BY 1),
  e AS MATERIALIZED (SELECT u, v, greatest(d, x.core, y.core) AS w, least(u, v) AS a, greatest(u, v) AS b FROM d JOIN c x ON x.id = u JOIN c y ON y.id = v),
  t(node, w, a, b, done) USING KEY (node) AS (SELECT v, w, a, b, false FROM e WHERE u = (SELECT min(id) FROM p)
    UNION (WITH pick AS (SELECT node, w, a, b FROM recurring.t WHERE NOT done ORDER BY w, a, b LIMIT 1)
      SELECT node, w, a, b, true FROM pick UNION ALL SELECT r.node, e.w, e.a, e.b, false FROM pick JOIN e ON e.u = pick.node JOIN recurring.t r ON r.node = e.v WHERE NOT r.done AND (e.w < r.w OR e.w = r.w AND (e.a < r.a OR e.a = r.a AND e.b < r.b))))
  SELECT a, b, w FROM t"""


@query(_TREE)
def reachability_tree(spark, sf_dir):
    """The least spanning tree of the embeddings' mutual reachability."""
    p = _points(spark, sf_dir)
    found = neighbours.exact_neighbours(p, NEAR)
    return hierarchy.spanning_tree(p, found, hierarchy.core_distances(found))


#: What is added to the component of a vector that its label names: topics are there to be found.
APART = 4.0


def _topical(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.transform("embedding", lambda x, k: x + F.when(k == F.col("label"), APART).otherwise(0.0))
    return neighbours.points(table(spark, sf_dir, "embeddings").withColumn("embedding", moved), "vec_id", "embedding", unit=False)


@query("SELECT vec_id AS id, topic FROM embeddings JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) - 1 AS topic FROM embeddings GROUP BY 1) USING (label)")
def topic_hierarchy(spark, sf_dir):
    """Topics of vectors that are apart by their labels, at no given distance, of 10 vectors at least; over lists from the forest."""
    p = _topical(spark, sf_dir)
    found = neighbours.forest_neighbours(p, NEAR)
    return hierarchy.cluster_labels(hierarchy.spanning_tree(p, found, hierarchy.core_distances(found)), p)


@query()
def topic_hierarchy_fine(spark, sf_dir):
    """Topics of the embeddings as they are, of 5 vectors at least, at the third neighbour."""
    p = _points(spark, sf_dir)
    found = neighbours.exact_neighbours(p, NEAR)
    return hierarchy.cluster_labels(hierarchy.spanning_tree(p, found, hierarchy.core_distances(found, 3)), p, 5)
