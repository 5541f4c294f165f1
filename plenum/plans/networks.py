"""Queries on graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import graphs, kernels
from plenum.operators.components import connected_components
from plenum.operators.inequality import gini
from plenum.plans.registry import EV, discourse, query
from plenum.storage import cut, table

_SPARSE = f"{EV}, p AS (SELECT DISTINCT k, hour, actor FROM ev), e AS (SELECT a.actor AS src, b.actor AS dst, count(*) AS weight FROM p a JOIN p b ON a.k = b.k AND a.hour = b.hour AND a.actor < b.actor GROUP BY 1, 2), nodes AS (SELECT DISTINCT actor AS node FROM ev)"
_BOTH = "both_ends AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def sparse(spark, sf_dir) -> DataFrame:
    return graphs.coparticipation(discourse(spark, sf_dir), ["k", "hour"], "actor")


def links(spark, sf_dir) -> DataFrame:
    """Edges with the components of sparse, without its pairs."""
    return graphs.thread_links(discourse(spark, sf_dir), ["k", "hour"], "actor")


def institutions(spark, sf_dir) -> DataFrame:
    """Actors of sparse with their institution, and how many of their neighbours are of it."""
    return graphs.shared_labels(discourse(spark, sf_dir).withColumn("label", F.col("actor") % 7), ["k", "hour"], "actor", "label")


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def actors(spark, sf_dir) -> DataFrame:
    return discourse(spark, sf_dir).select(F.col("actor").alias("node")).distinct()


@query(f"WITH {_SPARSE} SELECT src, dst, weight FROM e")
def copart_edges(spark, sf_dir):
    return sparse(spark, sf_dir)


@query(f"WITH {EV}, p AS (SELECT DISTINCT k, day, actor FROM ev) SELECT a.actor AS src, b.actor AS dst, count(*) AS weight FROM p a JOIN p b ON a.k = b.k AND a.day = b.day AND a.actor < b.actor GROUP BY 1, 2")
def copart_edges_dense(spark, sf_dir):
    return graphs.coparticipation(discourse(spark, sf_dir), ["k", "day"], "actor")


@query("WITH p AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT a.s AS src, b.s AS dst, count(*) AS weight FROM p a JOIN p b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2")
def copart_suppliers(spark, sf_dir):
    return graphs.coparticipation(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("SELECT a.conv_id, a.role AS src, b.role AS dst, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def reply_graph(spark, sf_dir):
    """Each turn replies to the one before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    to = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("dst"))
    return c.join(to, ["conv_id", "turn"]).select("conv_id", F.col("role").alias("src"), "dst", "turn")


@query(
    """WITH q AS (SELECT a.conv_id, a.role AS src, b.role AS dst, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2))
  SELECT conv_id, least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS quotes, min(turn) AS first_turn FROM q GROUP BY 1, 2, 3"""
)
def quote_graph(spark, sf_dir):
    """Each turn quotes the two before it; unordered pairs, the first turn of each."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    quoted = c.select("conv_id", F.col("turn").alias("at"), F.col("role").alias("a"), F.explode(F.array(F.col("turn") - 1, F.col("turn") - 2)).alias("turn"))
    j = quoted.join(c, ["conv_id", "turn"])
    return j.groupBy("conv_id", F.least("a", "role").alias("src"), F.greatest("a", "role").alias("dst")).agg(F.count("*").alias("quotes"), F.min("at").alias("first_turn"))


@query("SELECT DISTINCT 'order_' || l_orderkey AS src, 'supplier_' || l_suppkey AS dst, o_orderpriority AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def supernode_edges(spark, sf_dir):
    """Edges from a thread's own node to each who took part."""
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.concat(F.lit("order_"), "l_orderkey").alias("src"), F.concat(F.lit("supplier_"), "l_suppkey").alias("dst"), F.col("o_orderpriority").alias("kind"))


_STANCE = f"WITH {EV}, m AS (SELECT case_id, actor, theme, avg(stance) AS s FROM ev GROUP BY ALL), p AS (SELECT a.case_id, a.actor AS src, b.actor AS dst, a.s * b.s AS x FROM m a JOIN m b ON a.case_id = b.case_id AND a.theme = b.theme AND a.actor < b.actor)"


@query(_STANCE + " SELECT case_id, src, dst, count(*) FILTER (x > 0) AS weight, count(*) AS shared FROM p GROUP BY 1, 2, 3 HAVING count(*) FILTER (x > 0) > 0")
def congruence_edges(spark, sf_dir):
    return graphs.stance_edges(graphs.mean_stance(discourse(spark, sf_dir)), agree=True)


@query(_STANCE + " SELECT case_id, src, dst, count(*) FILTER (x < 0) AS weight, count(*) AS shared FROM p GROUP BY 1, 2, 3 HAVING count(*) FILTER (x < 0) > 0")
def conflict_edges(spark, sf_dir):
    return graphs.stance_edges(graphs.mean_stance(discourse(spark, sf_dir)), agree=False)


@query(f"WITH {_SPARSE} SELECT round(avg(CAST(src % 7 <> dst % 7 AS INTEGER)), 6) AS cross_share FROM e")
def cross_institution_share(spark, sf_dir):
    return graphs.counted_crossing(institutions(spark, sf_dir))


_BIP = "WITH c AS (SELECT l_suppkey AS s, p_type AS t, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


def _counts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("s"), F.col("p_type").alias("t")).agg(F.count("*").alias("n"))


@query(_BIP + " SELECT a.s AS src, b.s AS dst, CAST(sum(a.n * b.n) AS BIGINT) AS weight, count(*) AS n_shared FROM c a JOIN c b ON a.t = b.t AND a.s < b.s GROUP BY 1, 2")
def actor_projection(spark, sf_dir):
    return graphs.projection(_counts(spark, sf_dir), "s", "t", "n")


@query(_BIP + " SELECT a.t AS src, b.t AS dst, CAST(sum(a.n * b.n) AS BIGINT) AS weight, count(*) AS n_shared FROM c a JOIN c b ON a.s = b.s AND a.t < b.t GROUP BY 1, 2")
def theme_projection(spark, sf_dir):
    return graphs.projection(_counts(spark, sf_dir), "t", "s", "n")


@query("SELECT l_suppkey AS s, p_type AS t, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY GROUPING SETS ((l_suppkey, p_type), (l_suppkey), (p_type))")
def bipartite_weights(spark, sf_dir):
    """Weights of the pairs, and both sides' sums."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s"), F.col("p_type").alias("t"))
    return j.groupingSets([["s", "t"], ["s"], ["t"]], "s", "t").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_SPARSE}, {_BOTH}, d AS (SELECT node, count(dst) AS degree FROM nodes LEFT JOIN both_ends ON src = node GROUP BY 1), s AS (SELECT count(*) AS n, sum(degree) AS m2, max(degree) AS mx, round(avg(degree), 3) AS mean, count(*) FILTER (degree = 0) AS iso FROM d)
  SELECT n, CAST(m2 / 2 AS BIGINT) AS m, mean AS mean_degree, round(sqrt((SELECT avg(pow(degree - mean, 2)) FROM d)) / (n - 1), 6) AS centralisation, mx AS max_degree,
  round((SELECT sum(degree) FROM (SELECT degree FROM d ORDER BY degree DESC, node LIMIT 3)) / m2, 6) AS top3_share, round(CAST(m2 AS DOUBLE) / (n * (n - 1)), 6) AS density, iso AS isolates FROM s"""
)
def degree_metrics(spark, sf_dir):
    return graphs.degree_metrics(None, actors(spark, sf_dir), graphs.shared_degrees(discourse(spark, sf_dir), ["k", "hour"], "actor"))


@query(
    f"""WITH {_SPARSE}, {_BOTH}, d AS (SELECT src AS node, count(*) AS x FROM both_ends GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM d)
  SELECT round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini FROM r"""
)
def degree_gini(spark, sf_dir):
    return gini(graphs.shared_degrees(discourse(spark, sf_dir), ["k", "hour"], "actor"), "degree").select(F.round("gini", 6).alias("gini"))


@query(
    f"""WITH {_SPARSE}, {_BOTH}, m AS (SELECT count(*) AS m FROM e), d AS (SELECT src % 7 AS label, count(*) AS d FROM both_ends GROUP BY 1), i AS (SELECT src % 7 AS label, count(*) AS i FROM e WHERE src % 7 = dst % 7 GROUP BY 1)
  SELECT round(sum(coalesce(i, 0) / CAST(m AS DOUBLE) - pow(d / (2.0 * m), 2)), 6) AS q FROM d LEFT JOIN i USING (label) CROSS JOIN m"""
)
def label_modularity(spark, sf_dir):
    return graphs.counted_modularity(institutions(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_SPARSE}, {_BOTH}, r(node, root) AS (SELECT src, src FROM both_ends UNION SELECT b.dst, r.root FROM r JOIN both_ends b ON b.src = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY 1)
  SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c"""
)
def components(spark, sf_dir):
    c = connected_components(links(spark, sf_dir))
    return c.join(c.groupBy("component").agg(F.count("*").alias("size")), "component")


@query(
    f"""WITH RECURSIVE {_SPARSE}, {_BOTH}, b AS (SELECT DISTINCT src, dst FROM both_ends), r(s, node, d) AS (SELECT DISTINCT src, src, 0 FROM b UNION SELECT r.s, b.dst, r.d + 1 FROM r JOIN b ON b.src = r.node WHERE r.d < 16), m AS (SELECT s, node, min(d) AS d FROM r GROUP BY 1, 2)
  SELECT s AS node, round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) / ((SELECT count(DISTINCT src) FROM b) - 1), 6) AS harmonic FROM m GROUP BY 1"""
)
def harmonic(spark, sf_dir):
    return kernels.shared_harmonic(discourse(spark, sf_dir), ["k", "hour"], "actor")


_GIANT = "r(node, root) AS (SELECT src, src FROM both_ends UNION SELECT b.dst, r.root FROM r JOIN both_ends b ON b.src = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY 1), giant AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), own AS (SELECT node FROM c JOIN giant USING (component))"
_EIGEN = """ab AS MATERIALIZED (SELECT DISTINCT src, dst FROM both_ends WHERE src IN (SELECT node FROM own) UNION ALL SELECT node, node FROM own),
  x(i, node, v) AS (SELECT 0, node, CAST(1 AS DOUBLE) FROM own UNION ALL SELECT i + 1, node, y / sqrt(sum(y * y) OVER ()) FROM (SELECT x.i AS i, ab.dst AS node, sum(x.v) AS y FROM x JOIN ab ON ab.src = x.node WHERE x.i < 600 GROUP BY 1, 2))"""


def giant_edges(edges: DataFrame) -> DataFrame:
    c = connected_components(edges)
    giant = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return graphs.within(edges, c.join(F.broadcast(giant), "component"))


@query(f"WITH RECURSIVE {_SPARSE}, {_BOTH}, {_GIANT}, {_EIGEN} SELECT node, round(v, 6) AS eigenvector FROM x WHERE i = 600")
def eigenvector(spark, sf_dir):
    """Of the largest component."""
    return kernels.eigenvector(giant_edges(sparse(spark, sf_dir)), tol=1e-13)


_REACH = "b AS (SELECT DISTINCT src, dst FROM both_ends), w(s, node, d) AS (SELECT DISTINCT src, src, 0 FROM b UNION SELECT w.s, b.dst, w.d + 1 FROM w JOIN b ON b.src = w.node WHERE w.d < 16), m AS (SELECT s, node, min(d) AS d FROM w GROUP BY 1, 2)"
_THROUGH = """q(s, t, d, path) AS (SELECT DISTINCT src, src, 0, [src] FROM b UNION ALL SELECT q.s, b.dst, q.d + 1, list_append(q.path, b.dst) FROM q JOIN b ON b.src = q.t JOIN m ON m.s = q.s AND m.node = b.dst AND m.d = q.d + 1),
  n AS (SELECT s, t, count(*) AS c FROM q GROUP BY 1, 2), v AS (SELECT s, t, unnest(path[2:len(path) - 1]) AS node FROM q WHERE len(path) > 2), t AS (SELECT node, sum(1.0 / c) AS b FROM v JOIN n USING (s, t) GROUP BY 1)"""


@query(f"WITH RECURSIVE {_SPARSE}, {_BOTH}, {_REACH}, {_THROUGH}, k AS (SELECT count(DISTINCT src) AS k FROM b) SELECT i.node, round(coalesce(t.b, 0) / ((k - 1) * (k - 2)), 6) AS betweenness FROM (SELECT DISTINCT src AS node FROM b) i LEFT JOIN t ON t.node = i.node CROSS JOIN k")
def betweenness(spark, sf_dir):
    e = cut(sparse(spark, sf_dir))
    return kernels.betweenness(ends(e), e)


@query(
    f"""WITH RECURSIVE {_SPARSE}, b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), w(s, node, d) AS (SELECT DISTINCT src, src, CAST(0 AS BIGINT) FROM b UNION SELECT w.s, b.dst, w.d + b.weight FROM w JOIN b ON b.src = w.node WHERE w.d < 12), m AS (SELECT s, node, min(d) AS d FROM w GROUP BY 1, 2),
  {_THROUGH.replace("SELECT DISTINCT src, src, 0, [src]", "SELECT DISTINCT src, src, CAST(0 AS BIGINT), [src]").replace("q.d + 1", "q.d + b.weight")}, k AS (SELECT count(DISTINCT src) AS k FROM b)
  SELECT i.node, round(coalesce(t.b, 0) / ((k - 1) * (k - 2)), 6) AS betweenness FROM (SELECT DISTINCT src AS node FROM b) i LEFT JOIN t ON t.node = i.node CROSS JOIN k"""
)
def betweenness_weighted(spark, sf_dir):
    """Shared threads as distances."""
    e = cut(sparse(spark, sf_dir))
    return kernels.betweenness(ends(e), e, weighted=True)


_CONCENTRATED = "SELECT round(avg(x), 6) AS mean, round(max(x), 5) AS max, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 4) AS gini, round(sum(x) FILTER (i > n - 3) / sum(x), 4) AS top3_share FROM (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM {})"


@query(f"WITH RECURSIVE {_SPARSE}, {_BOTH}, {_REACH}, {_THROUGH}, k AS (SELECT count(*) AS k FROM nodes), z AS (SELECT round(coalesce(t.b, 0) / ((k - 1) * (k - 2)), 6) AS x FROM nodes LEFT JOIN t ON t.node = nodes.node CROSS JOIN k) {_CONCENTRATED.format('z')}")
def betweenness_concentration(spark, sf_dir):
    """How brokerage is shared out among all actors."""
    return graphs.concentration(kernels.betweenness(actors(spark, sf_dir), sparse(spark, sf_dir)), "betweenness")


@query(f"WITH RECURSIVE {_SPARSE}, {_BOTH}, {_REACH}, z AS (SELECT round(coalesce(sum(1.0 / d) FILTER (d > 0), 0) / ((SELECT count(*) FROM nodes) - 1), 6) AS x FROM nodes LEFT JOIN m ON m.s = nodes.node GROUP BY nodes.node) {_CONCENTRATED.format('z').replace('round(avg(x), 6) AS mean', 'round(avg(x), 6) AS mean, round(avg(x), 5) AS efficiency')}")
def network_efficiency(spark, sf_dir):
    """Harmonic centrality of all actors; its mean is the efficiency of the network."""
    h = cut(kernels.shared_harmonic(discourse(spark, sf_dir), ["k", "hour"], "actor", actors(spark, sf_dir)))  # read four times
    return graphs.concentration(h, "harmonic").crossJoin(h.agg(F.round(F.avg("harmonic"), 5).alias("efficiency")))  # one row each


@query(f"WITH RECURSIVE {_SPARSE}, {_BOTH}, {_GIANT}, {_EIGEN}, z AS (SELECT round(v, 6) AS x FROM x WHERE i = 600) {_CONCENTRATED.format('z')}")
def eigenvector_concentration(spark, sf_dir):
    return graphs.concentration(kernels.eigenvector(giant_edges(sparse(spark, sf_dir)), tol=1e-13), "eigenvector")


@query(f"WITH RECURSIVE {_SPARSE}, {_BOTH}, {_GIANT}, s AS (SELECT component, count(*) AS n FROM c GROUP BY 1), t AS (SELECT count(*) AS n FROM nodes) SELECT CAST((SELECT count(*) FROM s) + n - (SELECT sum(n) FROM s) AS BIGINT) AS n_components, (SELECT max(n) FROM s) AS giant, round((SELECT max(n) FROM s) / CAST(n AS DOUBLE), 4) AS giant_ratio FROM t")
def giant_component(spark, sf_dir):
    """Components of all actors, and the largest one's share."""
    return graphs.components_summary(connected_components(links(spark, sf_dir)), actors(spark, sf_dir))


@query()
def louvain_q(spark, sf_dir):
    """Communities, and the modularity of the partition."""
    found, q = kernels.communities(sparse(spark, sf_dir))
    return found.withColumn("q", F.lit(round(q, 6)))


@query()
def core_periphery(spark, sf_dir):
    return kernels.core_periphery(sparse(spark, sf_dir))


_ELBOW = f"""{EV}, rec AS (SELECT * FROM ev WHERE case_id = 0), cnt AS (SELECT actor, count(*) AS n FROM rec GROUP BY 1), rk AS (SELECT actor, n, row_number() OVER (ORDER BY n DESC, actor) AS i, lead(n) OVER (ORDER BY n DESC, actor) AS m FROM cnt),
  cutoff AS (SELECT least(80, coalesce((SELECT i FROM rk WHERE m IS NOT NULL AND i BETWEEN 20 AND 80 ORDER BY (n - m) / CAST(n AS DOUBLE) DESC, i LIMIT 1), (SELECT count(*) FROM cnt))) AS c), top AS (SELECT actor FROM rk, cutoff WHERE i <= c)"""


@query(f"WITH {_ELBOW}, p AS (SELECT DISTINCT k, day, actor FROM rec WHERE actor IN (SELECT actor FROM top)) SELECT a.actor AS src, b.actor AS dst, count(*) AS weight, round(greatest(1, least(8, 1 + log2(count(*) + 1))), 6) AS width FROM p a JOIN p b ON a.k = b.k AND a.day = b.day AND a.actor < b.actor GROUP BY 1, 2")
def elbow_edges(spark, sf_dir):
    """Threads shared by the authors above the elbow of one case, and the widths to draw them with."""
    from plenum.functions.numbers import edge_width

    e = graphs.elbow_graph(discourse(spark, sf_dir).filter("case_id = 0"), ["k", "day"], "actor")
    return e.withColumn("width", F.round(edge_width(F.col("weight")), 6))


#: Turns of conversations as numbered posts that reply to the one before and sometimes quote two.
_POSTS = """posts AS (SELECT conv_id, turn AS post_number, turn - 1 AS reply_to_post_number, role || '_' || ((conv_id + turn) % 11) AS author, CASE length(text) % 4 WHEN 0 THEN 'Support' WHEN 1 THEN 'Oppose' WHEN 2 THEN 'Modify' END AS stance, CASE WHEN turn % 3 = 0 THEN [turn - 1, turn - 2] ELSE [] END AS quoted, CASE WHEN conv_id % 2 = 0 THEN conv_id % 20 END AS pr_number FROM conversations)"""


def posts(spark, sf_dir) -> DataFrame:
    quoted = F.when(F.col("turn") % 3 == 0, F.array(F.col("turn") - 1, F.col("turn") - 2)).otherwise(F.array().cast("array<bigint>"))
    stance = F.expr("CASE length(text) % 4 WHEN 0 THEN 'Support' WHEN 1 THEN 'Oppose' WHEN 2 THEN 'Modify' END")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("post_number"), (F.col("turn") - 1).alias("reply_to_post_number"), F.expr("role || '_' || ((conv_id + turn) % 11)").alias("author"), stance.alias("stance"), quoted.alias("quoted_post_numbers"),
        F.expr("CASE WHEN conv_id % 2 = 0 THEN conv_id % 20 END").alias("pr_number"),
    )


@query(
    f"""WITH {_POSTS}, j AS (SELECT a.author AS src, b.author AS dst, coalesce(a.stance, 'Neutral') AS stance, row_number() OVER (PARTITION BY a.author, b.author ORDER BY a.conv_id, a.post_number) AS i FROM posts a JOIN posts b ON a.conv_id = b.conv_id AND b.post_number = a.reply_to_post_number WHERE a.author <> b.author),
  q AS (SELECT DISTINCT least(a.author, b.author) AS src, greatest(a.author, b.author) AS dst FROM (SELECT conv_id, author, unnest(quoted) AS q FROM posts) a JOIN posts b ON a.conv_id = b.conv_id AND b.post_number = a.q WHERE a.author <> b.author)
  SELECT src, dst, 'reply' AS type, stance FROM j WHERE i = 1 UNION ALL SELECT src, dst, 'quote', NULL FROM q UNION ALL SELECT DISTINCT author, 'PR_' || pr_number, 'pr_edge', NULL FROM posts WHERE pr_number IS NOT NULL"""
)
def discussion_graph(spark, sf_dir):
    """Replies with the stance of the first, quotes, and edges to the nodes of threads, as one graph."""
    p = posts(spark, sf_dir)
    return graphs.reply_edges(p, keys=("conv_id",)).unionByName(graphs.quote_edges(p, keys=("conv_id",))).unionByName(graphs.thread_edges(p, "author", "pr_number"))


@query(
    f"""WITH {_SPARSE}, {_BOTH}, s AS (SELECT node, sum(weight) AS s FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1), t AS (SELECT node FROM s ORDER BY s DESC, node LIMIT 100)
  SELECT src, dst, weight FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)"""
)
def induced_topk(spark, sf_dir):
    return graphs.top_subgraph(sparse(spark, sf_dir), 100).select("src", "dst", "weight")


@query()
def network_table(spark, sf_dir):
    """The metrics of the networks of both cases, a row for each metric and a column for each case."""
    from plenum.operators.reports import network_metrics
    from plenum.sources.files import metric_table

    rows = None
    for case in (0, 1):
        e = discourse(spark, sf_dir).filter(F.col("case_id") == case)
        own = network_metrics(cut(graphs.coparticipation(e, ["k", "hour"], "actor")), e.select(F.col("actor").alias("node")).distinct().withColumn("grp", F.col("node") % 7)).withColumn("case", F.lit(f"case_{case}"))
        rows = own if rows is None else rows.unionByName(own)
    return metric_table(rows, "case")


@query()
def graph_layout(spark, sf_dir):
    """Places of the actors of a graph for drawing: those of the largest component by springs, the others on a ring."""
    from plenum.operators import layout

    e = cut(sparse(spark, sf_dir))
    big = cut(ends(giant_edges(cut(graphs.top_subgraph(e, 200)))))
    inner = layout.scaled(layout.springs(big, e, iterations=60))
    beside = graphs.degrees(e).orderBy(F.desc("strength"), "node").limit(200).select("node").join(big, "node", "left_anti")
    return inner.unionByName(layout.ring(beside))


@query(
    """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM p), d AS (SELECT *, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM p, c), r AS (SELECT quantile_cont(d, 0.95) AS r FROM d)
  SELECT vec_id, round(cx + (x - cx) * 0.42 * CASE WHEN d > r THEN r / d ELSE 1 END, 6) AS x, round(cy + (y - cy) * 0.42 * CASE WHEN d > r THEN r / d ELSE 1 END, 6) AS y FROM d, r"""
)
def drawn_in_points(spark, sf_dir):
    """Outliers at the 95th percentile of the distances, and all points towards the centre."""
    from plenum.operators import layout

    p = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return layout.draw_in(p).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT n_nationkey AS node, round(0.88 * cos(2 * pi() * i / n), 6) AS x, round(0.88 * sin(2 * pi() * i / n), 6) AS y FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation)")
def ring_places(spark, sf_dir):
    """Nodes around a circle, unmoved."""
    from plenum.operators import layout

    r = layout.ring(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), depth=0.0, turn=0.0)
    return r.select("node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {_SPARSE} SELECT true AS covers_all, true AS q_agrees, true AS beats_institutions, (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e)) AS n")
def louvain_checks(spark, sf_dir):
    """The partition has every node once, its modularity is what a sum over the edges gives, and it is better than that of the institutions."""
    e = cut(sparse(spark, sf_dir))
    found, q = kernels.communities(e)
    again = graphs.label_modularity(e, found.withColumnRenamed("community", "label"), weighted=True).first()["q"]
    other = graphs.label_modularity(e, ends(e).withColumn("label", F.col("node") % 7), weighted=True).first()["q"]
    n = ends(e).count()
    return found.agg((F.count_distinct("node") == n).alias("covers_all"), F.lit(abs(again - q) < 1e-5).alias("q_agrees"), F.lit(q > other).alias("beats_institutions"), F.count("*").alias("n"))


@query(f"WITH {_SPARSE} SELECT true AS fit_agrees, true AS no_single_change_is_better, true AS p_is_a_share")
def core_checks(spark, sf_dir):
    """The fit of the core is the correlation of the edges with its pattern over all pairs, and no node that changes sides raises it."""
    e = cut(sparse(spark, sf_dir))
    g = kernels.Packed(kernels.simple_edges(e))
    core, fit = kernels._core_fit(g)
    best, other = kernels.core_changes(g, core)
    worse = other <= best + 1e-9
    r = kernels.core_periphery(e).first()
    return spark.range(1).select(F.lit(abs(best - fit) < 1e-9).alias("fit_agrees"), F.lit(worse).alias("no_single_change_is_better"), F.lit(0 < r["p_value"] <= 1).alias("p_is_a_share"))
