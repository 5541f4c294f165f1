"""Queries on inequality, shares, association and agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import association, inequality
from plenum.plans.registry import EV, discourse, query
from plenum.storage import table

CATEGORIES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PHASES = [("early", "2024-01-01", "2024-01-10"), ("middle", "2024-01-10", "2024-01-20"), ("late", "2024-01-20", "2024-02-01")]

_COUNTS = f"WITH {EV}, c AS (SELECT case_id, actor, theme, count(*) AS n FROM ev GROUP BY ALL)"
_DIVERSITY = (
    _COUNTS
    + """, t AS (SELECT case_id, count(DISTINCT theme) AS of FROM c GROUP BY 1),
  r AS (SELECT c.*, sum(n) OVER (PARTITION BY case_id, actor) AS total, row_number() OVER (PARTITION BY case_id, actor ORDER BY n, theme DESC) AS i, count(*) OVER (PARTITION BY case_id, actor) AS k FROM c),
  d AS (SELECT case_id, actor, CAST(sum(n) AS BIGINT) AS n_comments, count(*) AS n_themes, -sum(n / total * log2(n / total)) AS entropy,
    sum((2 * (t.of - k + i) - t.of - 1) * n) / (max(t.of) * sum(n)) AS gini, arg_max(theme, i) AS top_theme FROM r JOIN t USING (case_id) GROUP BY 1, 2)"""
)


@query(_DIVERSITY + " SELECT case_id, actor, n_comments, n_themes, round(entropy, 6) AS entropy, round(gini, 6) AS gini, top_theme FROM d")
def actor_diversity(spark, sf_dir):
    return inequality.actor_diversity(discourse(spark, sf_dir))


@query(
    _COUNTS
    + """, r AS (SELECT *, sum(n) OVER w AS total, row_number() OVER (w ORDER BY n) AS i, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY case_id, theme))
  SELECT case_id, theme, CAST(sum(n) AS BIGINT) AS n_comments, count(*) AS n_actors, round(sum((n / total) * (n / total)), 4) AS hhi, round(sum((2 * i - k - 1) * n) / (max(k) * sum(n)), 6) AS gini_actors FROM r GROUP BY 1, 2"""
)
def theme_concentration(spark, sf_dir):
    return inequality.theme_concentration(discourse(spark, sf_dir))


@query(
    _DIVERSITY
    + """, e AS (SELECT case_id, round(entropy, 6) AS x FROM d), i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY x) AS i, count(*) OVER (PARTITION BY case_id) AS k FROM e)
  SELECT case_id, round(avg(x), 6) AS mean_entropy, round(median(x), 6) AS median_entropy, round(max(x), 6) AS max_entropy, round(sum((2 * i - k - 1) * x) / (max(k) * sum(x)), 6) AS gini_entropy FROM i GROUP BY 1"""
)
def entropy_summary(spark, sf_dir):
    d = inequality.actor_diversity(discourse(spark, sf_dir))
    g = inequality.gini(d, "entropy", ["case_id"], ranges=True).withColumn("gini_entropy", F.round("gini", 6)).drop("gini")
    return d.groupBy("case_id").agg(F.round(F.avg("entropy"), 6).alias("mean_entropy"), F.round(F.median("entropy"), 6).alias("median_entropy"), F.round(F.max("entropy"), 6).alias("max_entropy")).join(g, "case_id")


@query(
    f"WITH {EV}, d AS (SELECT unnest({CATEGORIES}) AS category), n AS (SELECT case_id, count(*) AS of FROM ev GROUP BY 1), c AS (SELECT case_id, category, count(*) AS n FROM ev GROUP BY ALL)"
    " SELECT n.case_id, d.category, coalesce(c.n, 0) AS n, round(100.0 * coalesce(c.n, 0) / n.of, 6) AS pct FROM n CROSS JOIN d LEFT JOIN c ON c.case_id = n.case_id AND c.category = d.category"
)
def category_share(spark, sf_dir):
    return association.shares(discourse(spark, sf_dir), "case_id", "category", CATEGORIES)


_CROSS = ", ".join(f"round(100.0 * count(*) FILTER (o_orderpriority = '{p}') / count(*), 6) AS \"{p}\"" for p in PRIORITIES)


@query(f"SELECT o_orderstatus, {_CROSS} FROM orders WHERE o_orderpriority IN {tuple(PRIORITIES)} GROUP BY 1")
def stance_crosstab(spark, sf_dir):
    return association.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", PRIORITIES)


_CHI2 = """, g AS (SELECT r.r, c.c, coalesce(o.n, 0) AS o, r.n AS nr, c.n AS nc, (SELECT sum(n) FROM o) AS n FROM (SELECT r, sum(n) AS n FROM o GROUP BY 1) r CROSS JOIN (SELECT c, sum(n) AS n FROM o GROUP BY 1) c LEFT JOIN o ON o.r = r.r AND o.c = c.c),
  t AS (SELECT sum((o - CAST(nr * nc AS DOUBLE) / n) * (o - CAST(nr * nc AS DOUBLE) / n) / (CAST(nr * nc AS DOUBLE) / n)) AS chi2, count(DISTINCT r) AS kr, count(DISTINCT c) AS kc, CAST(max(n) AS BIGINT) AS n FROM g)
  SELECT round(chi2, 6) AS chi2, (kr - 1) * (kc - 1) AS dof, n, round(sqrt(chi2 / (n * (least(kr, kc) - 1))), 6) AS cramers_v FROM t"""


@query("WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL)" + _CHI2)
def contingency_chi2(spark, sf_dir):
    return association.chi_square(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


_PHASE = "CASE " + " ".join(f"WHEN ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' THEN '{n}'" for n, a, b in PHASES) + " END"


@query(f"WITH {EV}, o AS (SELECT {_PHASE} AS r, category AS c, count(*) AS n FROM ev WHERE category <> 'error' AND {_PHASE} IS NOT NULL GROUP BY ALL)" + _CHI2)
def lifecycle_chi2(spark, sf_dir):
    from plenum.operators.timebins import phase

    rows = discourse(spark, sf_dir).filter("category <> 'error'").withColumn("phase", phase(F.col("ts"), PHASES))
    return association.chi_square(rows, "phase", "category")


def _tail(x: str, k: str) -> str:
    """SQL: the tail of chi-square by Simpson's rule over the root of its variable."""
    f = f"2 * pow(i * sqrt({x}) / 2000, {k} - 1) * exp(-pow(i * sqrt({x}) / 2000, 2) / 2) / (pow(2, {k} / 2.0) * gamma({k} / 2.0))"
    return f"greatest(0, 1 - sqrt({x}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f})))"


_STARS = "CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"


@query(f"WITH g AS (SELECT x, k, {_tail('x', 'k')} AS p FROM (SELECT CAST(unnest([0.5, 3.841, 5.991, 11.345, 52.88]) AS DOUBLE) AS x) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 12]) AS k)) SELECT x, k AS dof, round(p, 6) AS p, {_STARS.format(p='p')} AS label FROM g")
def chi2_tail(spark, sf_dir):
    """p-values of a grid of statistics and degrees of freedom, with their labels."""
    grid = spark.createDataFrame([(x, k) for x in (0.5, 3.841, 5.991, 11.345, 52.88) for k in (1, 2, 3, 4, 12)], "x double, dof int").withColumn("p", association.chi2_p("x", "dof"))
    return grid.select("x", "dof", F.round("p", 6).alias("p"), association.significance(F.col("p")).alias("label"))


def _chi_test_sql(counts: str) -> str:
    """SQL of a test on counts (r, c, n)."""
    return f"""o AS ({counts}), nr AS (SELECT r, sum(n) AS nr FROM o GROUP BY 1 HAVING sum(n) > 0), nc AS (SELECT c, sum(n) AS nc FROM o GROUP BY 1 HAVING sum(n) > 0), tt AS (SELECT CAST(sum(nr) AS BIGINT) AS n, (SELECT count(*) FROM nr) AS kr, (SELECT count(*) FROM nc) AS kc FROM nr),
  g AS (SELECT coalesce(o.n, 0) AS o, CAST(nr * nc AS DOUBLE) / tt.n AS e, tt.n AS n, (kr - 1) * (kc - 1) AS dof, least(kr, kc) - 1 AS k FROM nr CROSS JOIN nc CROSS JOIN tt LEFT JOIN o ON o.r = nr.r AND o.c = nc.c),
  s AS (SELECT sum(pow(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2, max(dof) AS dof, max(n) AS n, max(k) AS k FROM g), z AS (SELECT *, {_tail('chi2', 'dof')} AS p, sqrt(chi2 / (n * k)) AS v FROM s)
  SELECT round(chi2, 3) AS chi2, dof, n, round(p, 6) AS p_value, round(v, 4) AS cramers_v, {_STARS.format(p='p')} AS stars, CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small' WHEN v < 0.5 THEN 'medium' ELSE 'large' END AS effect, CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS interpretation FROM z"""


_KEPT = [p for p in PRIORITIES if not p.startswith("4")]


@query("WITH " + _chi_test_sql(f"SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders WHERE o_orderpriority IN {tuple(_KEPT)} GROUP BY ALL"))
def chi_square_test(spark, sf_dir):
    """The test of independence without one category: statistic, p-value, effect and what they mean."""
    return association.chi_test(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", _KEPT)


@query("WITH " + _chi_test_sql("SELECT quality AS r, CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS c, count(*) AS n FROM labels GROUP BY ALL"))
def chi_square_two_by_two(spark, sf_dir):
    """The same with one degree of freedom, corrected for continuity."""
    rows = table(spark, sf_dir, "labels").withColumn("c", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    return association.chi_test(rows, "quality", "c", ["clean", "toxic"])


@query(f"WITH {EV}, " + _chi_test_sql(f"SELECT {_PHASE} AS r, category AS c, count(*) AS n FROM ev WHERE category <> 'error' AND {_PHASE} IS NOT NULL GROUP BY ALL"))
def lifecycle_test(spark, sf_dir):
    """Phases by category."""
    from plenum.operators.timebins import phase

    rows = discourse(spark, sf_dir).withColumn("phase", phase(F.col("ts"), PHASES))
    return association.chi_test(rows, "phase", "category", [c for c in CATEGORIES if c != "error"])


_KAPPA = "SELECT '{f}' AS field, count(*) AS n, CASE WHEN pe = 1 THEN 1 ELSE round((avg(CAST(a = b AS INTEGER)) - max(pe)) / (1 - max(pe)), 6) END AS kappa FROM (SELECT {a} AS a, {b} AS b FROM labels), (SELECT sum(x * y) AS pe FROM (SELECT avg(CAST({a} = v AS INTEGER)) AS x, avg(CAST({b} = v AS INTEGER)) AS y FROM labels, (SELECT unnest([0, 1, 2]) AS v) GROUP BY v)) GROUP BY pe"


@query(
    "WITH k AS (" + " UNION ALL ".join(_KAPPA.format(f=f, a=a, b=b) for f, a, b in (("quality", "quality", "1 - toxic"), ("toxic", "toxic", "CAST(doc_id % 2 AS INTEGER)"), ("both", "quality + toxic", "CAST(doc_id % 3 AS INTEGER)")))
    + "), m AS (SELECT * FROM k UNION ALL SELECT 'mean', max(n), round(avg(kappa), 6) FROM k) SELECT *, CASE WHEN kappa < 0.2 THEN 'Poor' WHEN kappa < 0.4 THEN 'Fair' WHEN kappa < 0.6 THEN 'Moderate' WHEN kappa < 0.8 THEN 'Substantial' ELSE 'Almost Perfect' END AS label FROM m"
)
def kappa_table(spark, sf_dir):
    """Agreement on several fields, and its mean."""
    p = table(spark, sf_dir, "labels").selectExpr("quality", "toxic", "quality + toxic AS both", "1 - toxic AS clean", "CAST(doc_id % 2 AS INT) AS two", "CAST(doc_id % 3 AS INT) AS three")
    return association.kappa_table(p, {"quality": ("quality", "clean"), "toxic": ("toxic", "two"), "both": ("both", "three")})


@query(
    """WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), s AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po,
  (avg(CAST(a = 1 AS INTEGER)) * avg(CAST(b = 1 AS INTEGER)) + avg(CAST(a = 0 AS INTEGER)) * avg(CAST(b = 0 AS INTEGER))) AS pe FROM p)
  SELECT n, round(po, 6) AS p_o, round(pe, 6) AS p_e, round((po - pe) / (1 - pe), 6) AS kappa,
  CASE WHEN (po - pe) / (1 - pe) < 0.2 THEN 'Poor' WHEN (po - pe) / (1 - pe) < 0.4 THEN 'Fair' WHEN (po - pe) / (1 - pe) < 0.6 THEN 'Moderate' WHEN (po - pe) / (1 - pe) < 0.8 THEN 'Substantial' ELSE 'Almost Perfect' END AS label FROM s"""
)
def cohen_kappa(spark, sf_dir):
    k = association.cohen_kappa(table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("clean")), "quality", "clean")
    return k.withColumn("label", association.kappa_label(F.col("kappa")))


@query(
    """WITH p AS (SELECT CAST(quality AS VARCHAR) AS a, CAST(1 - toxic AS VARCHAR) AS b FROM labels), l AS (SELECT a AS x FROM p UNION SELECT b FROM p)
  SELECT l.x AS a, m.x AS b, count(p.a) AS n FROM l CROSS JOIN l m LEFT JOIN p ON p.a = l.x AND p.b = m.x GROUP BY 1, 2"""
)
def confusion_matrix(spark, sf_dir):
    return association.confusion_matrix(table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("clean")), "quality", "clean")


_JSD = f"""WITH {EV}, t AS (SELECT theme AS topic, count(*) FILTER (case_id = 0) AS n_a, count(*) FILTER (case_id = 1) AS n_b FROM ev GROUP BY 1),
  s AS (SELECT *, round(100.0 * n_a / sum(n_a) OVER (), 2) AS pct_a, round(100.0 * n_b / sum(n_b) OVER (), 2) AS pct_b FROM t),
  p AS (SELECT *, (pct_a / 100 + 1e-10) / sum(pct_a / 100 + 1e-10) OVER () AS p, (pct_b / 100 + 1e-10) / sum(pct_b / 100 + 1e-10) OVER () AS q FROM s),
  k AS (SELECT *, p * ln(p / ((p + q) / 2)) AS kl_a, q * ln(q / ((p + q) / 2)) AS kl_b FROM p)"""


@query(_JSD + " SELECT topic, n_a, n_b, pct_a, pct_b, round(abs(pct_a - pct_b), 6) AS abs_diff, round(kl_a, 6) AS kl_a, round(kl_b, 6) AS kl_b, round((kl_a + kl_b) / 2, 6) AS js_contribution, round(sum((kl_a + kl_b) / 2) OVER (), 6) AS js_total FROM k")
def js_divergence(spark, sf_dir):
    counts = discourse(spark, sf_dir).groupBy("theme").agg(F.count_if(F.expr("case_id = 0")).alias("n_a"), F.count_if(F.expr("case_id = 1")).alias("n_b"))
    t = inequality.divergence_table(counts, "theme", "n_a", "n_b")
    return t.select("topic", "n_a", "n_b", "pct_a", "pct_b", *[F.round(c, 6).alias(c) for c in ("abs_diff", "kl_a", "kl_b", "js_contribution", "js_total")])


@query(_JSD + ", r AS (SELECT topic, round((kl_a + kl_b) / 2, 6) AS c, (kl_a + kl_b) / 2 AS x FROM k), five AS (SELECT * FROM r ORDER BY x DESC, topic LIMIT 5) SELECT (SELECT round(sum(x), 6) FROM r) AS js_total, (SELECT count(*) FROM r) AS topics, (SELECT string_agg(topic || ':' || printf('%.6f', c), '; ' ORDER BY c DESC, CAST(topic AS VARCHAR)) FROM five) AS top")
def divergence_summary(spark, sf_dir):
    """The divergence of two communities, and the topics that add most to it."""
    counts = discourse(spark, sf_dir).groupBy("theme").agg(F.count_if(F.expr("case_id = 0")).alias("n_a"), F.count_if(F.expr("case_id = 1")).alias("n_b"))
    return inequality.divergence_summary(inequality.divergence_table(counts, "theme", "n_a", "n_b"))


@query(
    f"""WITH {EV} SELECT theme, round(100.0 * count(*) FILTER (case_id = 0) / (SELECT count(*) FROM ev WHERE case_id = 0), 6) AS pct_a, round(100.0 * count(*) FILTER (case_id = 1) / (SELECT count(*) FROM ev WHERE case_id = 1), 6) AS pct_b,
  round(100.0 * count(*) FILTER (case_id = 0) / (SELECT count(*) FROM ev WHERE case_id = 0) - 100.0 * count(*) FILTER (case_id = 1) / (SELECT count(*) FROM ev WHERE case_id = 1), 6) AS delta FROM ev GROUP BY 1"""
)
def record_share_delta(spark, sf_dir):
    whole = Window.partitionBy()  # a row for each theme
    t = discourse(spark, sf_dir).groupBy("theme").agg(F.count_if(F.expr("case_id = 0")).alias("a"), F.count_if(F.expr("case_id = 1")).alias("b"))
    t = t.withColumn("pa", 100.0 * F.col("a") / F.sum("a").over(whole)).withColumn("pb", 100.0 * F.col("b") / F.sum("b").over(whole))
    return t.select("theme", F.round("pa", 6).alias("pct_a"), F.round("pb", 6).alias("pct_b"), F.round(F.col("pa") - F.col("pb"), 6).alias("delta"))


@query(
    """WITH a AS (SELECT DISTINCT source AS s FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source AS s FROM documents WHERE lang = 'es'), x AS (SELECT a.s AS p, b.s AS q FROM a FULL JOIN b ON a.s = b.s)
  SELECT count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) AS n_shared, count(*) FILTER (q IS NULL) AS only_a, count(*) FILTER (p IS NULL) AS only_b,
  round(count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) / least(count(p), count(q)), 6) AS overlap FROM x"""
)
def overlap_coefficient(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return inequality.overlap(d.filter("lang = 'en'"), d.filter("lang = 'es'"), "source")


@query(f"WITH {EV}, a AS (SELECT case_id, actor, count(DISTINCT theme) AS n FROM ev GROUP BY 1, 2) SELECT case_id, round(avg(n), 6) AS mean_themes FROM a GROUP BY 1")
def mean_theme_diversity(spark, sf_dir):
    return discourse(spark, sf_dir).groupBy("case_id", "actor").agg(F.countDistinct("theme").alias("n")).groupBy("case_id").agg(F.round(F.avg("n"), 6).alias("mean_themes"))


_GRID = [k / 4 for k in range(0, 21)]


@query(
    _DIVERSITY
    + f""", e AS (SELECT case_id, round(entropy, 6) AS x FROM d), h AS (SELECT case_id, 0.3 * stddev_samp(x) AS h, count(*) AS n FROM e GROUP BY 1), g AS (SELECT unnest({_GRID}) AS g)
  SELECT e.case_id, CAST(g.g AS DOUBLE) AS grid, round(2 * sum(exp(-0.5 * pow((g - x) / h, 2)) + exp(-0.5 * pow((g + x) / h, 2))) / (2 * max(n) * max(h) * sqrt(2 * pi())), 6) AS density FROM e JOIN h USING (case_id) CROSS JOIN g GROUP BY 1, 2"""
)
def entropy_kde(spark, sf_dir):
    from plenum.functions.numbers import reflected_kde

    return reflected_kde(inequality.actor_diversity(discourse(spark, sf_dir)), "case_id", "entropy", _GRID, 0.3)


@query(
    _DIVERSITY
    + """, e AS (SELECT case_id, round(entropy, 6) AS x FROM d), b AS (SELECT min(x) AS lo, max(x) AS hi FROM e)
  SELECT case_id, CAST(least(14, floor((x - lo) / (hi - lo) * 15)) AS INTEGER) AS bin, count(*) AS n FROM e CROSS JOIN b GROUP BY 1, 2"""
)
def entropy_histogram(spark, sf_dir):
    from plenum.functions.numbers import histogram

    return histogram(inequality.actor_diversity(discourse(spark, sf_dir)), "case_id", "entropy", 15)
