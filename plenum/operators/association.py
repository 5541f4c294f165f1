"""Contingency tables, tests of association and rater agreement."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


#: Labels of a confusion matrix, whose cells are the square of their number.
MOST_LABELS = 1000


def shares(rows: DataFrame, key: str, category: str, order: list[str], digits: int = 6) -> DataFrame:
    """Share of each category of order within each key, zeros too; the denominator is all rows of the key."""
    named = rows.groupBy(key).agg(F.count("*").alias("of"), *[F.count_if(F.col(category) == c).alias(f"c{k}") for k, c in enumerate(order)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"c{k}").alias("n")) for k, c in enumerate(order)]))
    return named.select(key, "of", cells.alias("x")).select(key, F.col("x.category").alias("category"), F.col("x.n").alias("n"), F.round(100.0 * F.col("x.n") / F.col("of"), digits).alias("pct"))


def crosstab(rows: DataFrame, row: str, column: str, order: list[str]) -> DataFrame:
    """Row-normalised shares, in percent; values outside order are dropped, an empty row has zeros."""
    kept = rows.filter(F.col(column).isin(order))
    total = F.nullif(F.count("*"), F.lit(0))
    return kept.groupBy(row).agg(*[F.round(F.coalesce(100.0 * F.count_if(F.col(column) == c) / total, F.lit(0.0)), 6).alias(c) for c in order])


def chi_square(rows: DataFrame, row: str, column: str) -> DataFrame:
    """One row: Pearson's chi2, dof, n and Cramér's V of the table of two columns. Cells that expect nothing are left out.

    The sum of (o - e)^2 / e over all cells is n times the sum of o^2 / (row total times column total), less n, so that empty
    cells need not be made.
    """
    cells = rows.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("o"))
    sums = cells.withColumn("nr", F.sum("o").over(Window.partitionBy("r"))).withColumn("nc", F.sum("o").over(Window.partitionBy("c")))  # categories, not rows
    agg = sums.agg(F.sum(F.col("o").cast("double") * F.col("o") / (F.col("nr").cast("double") * F.col("nc"))).alias("s"), F.count_distinct("r").alias("rows"), F.count_distinct("c").alias("columns"), F.sum("o").alias("n"))
    agg = agg.withColumn("chi2", F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1)))
    k = F.least("rows", "columns") - 1
    return agg.select(
        F.round("chi2", 6).alias("chi2"), ((F.col("rows") - 1) * (F.col("columns") - 1)).cast("long").alias("dof"), "n",
        F.round(F.when(k > 0, F.sqrt(F.col("chi2") / (F.col("n") * k))).otherwise(0.0), 6).alias("cramers_v"),
    )


def contingency(rows: DataFrame, row: str, column: str, order: list[str]) -> DataFrame:
    """One row: o, the counts of the table's rows (those with any of the columns of order), and their totals nr and nc, and n."""
    counts = rows.filter(F.col(row).isNotNull()).groupBy(row).agg(F.array(*[F.count_if(F.col(column) == c) for c in order]).alias("c"))
    kept = counts.filter(F.exists("c", lambda x: x > 0)).orderBy(row)
    return kept.agg(F.collect_list("c").alias("o"))  # a row for each case or phase


def chi_test(rows: DataFrame, row: str, column: str, order: list[str]) -> DataFrame:
    """One row: chi2, dof, n, p_value, Cramér's V, and what they mean. Columns are those of order; rows without any are dropped.

    With one degree of freedom every count moves half towards what is expected (or all the way, if that is nearer).
    """
    t = contingency(rows, row, column, order).withColumn("nr", F.transform("o", lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda s, x: s + x)))
    nc = F.aggregate("o", F.transform(F.get("o", F.lit(0)), lambda x: F.lit(0).cast("long")), lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    t = t.withColumn("nc", nc).withColumn("n", F.aggregate("nr", F.lit(0).cast("long"), lambda s, x: s + x))
    used = F.size(F.filter("nc", lambda x: x > 0))
    t = t.withColumn("dof", (F.size("nr") - 1) * (used - 1)).withColumn("k", F.least(F.size("nr"), used) - 1)
    expected = lambda i, j: F.get("nr", i) * F.get("nc", j) / F.col("n")

    def cell(i: Column, j: Column, o: Column) -> Column:
        gap = F.abs(o - expected(i, j))
        gap = gap - F.when(F.col("dof") == 1, F.least(F.lit(0.5), gap)).otherwise(F.lit(0.0))
        return F.when(expected(i, j) > 0, gap * gap / expected(i, j)).otherwise(F.lit(0.0))

    parts = F.transform("o", lambda r, i: F.aggregate(F.transform(r, lambda o, j: cell(i, j, o)), F.lit(0.0), lambda s, x: s + x))
    t = t.withColumn("chi2", F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)).withColumn("p", chi2_p("chi2", "dof"))
    v = F.when((F.col("k") > 0) & (F.col("n") > 0), F.sqrt(F.col("chi2") / (F.col("n") * F.col("k")))).otherwise(0.0)
    return t.select(
        F.round("chi2", 3).alias("chi2"), F.col("dof").cast("long").alias("dof"), "n", F.round("p", 6).alias("p_value"), F.round(v, 4).alias("cramers_v"), significance(F.col("p")).alias("stars"),
        effect_label(v).alias("effect"), F.when(F.col("p") < 0.05, "significant").otherwise("not significant").alias("interpretation"),
    )


def chi2_tail(x: float, dof: int) -> float:
    """Probability of more than x under chi-square of dof degrees of freedom, in closed form."""
    if x <= 0 or dof <= 0:
        return 1.0
    h = x / 2
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, dof // 2):
            term *= h / k
            total += term
        return min(1.0, math.exp(-h) * total)
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h / math.pi) * 2
    for k in range(1, (dof + 1) // 2):
        total += term
        term *= h / (k + 0.5)
    return min(1.0, total)


def chi2_p(x: str, dof: str) -> Column:
    """The tail probability of columns of statistics and degrees of freedom."""

    @pandas_udf("double")
    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(k) else chi2_tail(float(a), int(k)) for a, k in zip(x, dof, strict=True)], dtype="float64")

    return tail(x, dof)


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def effect_label(v: Column) -> Column:
    return F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").otherwise("large")


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed and expected agreement and kappa (1 where chance alone agrees always)."""
    p = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    labels = p.select("n", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("label")), F.struct(F.lit("b").alias("side"), F.col("b").alias("label")))).alias("x"))
    margins = labels.groupBy("x.label").agg(F.sum(F.when(F.col("x.side") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.side") == "b", F.col("n")).otherwise(0)).alias("nb"))
    expected = margins.agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("pe"))
    observed = p.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    both = observed.crossJoin(expected).withColumn("po", F.col("agree") / F.col("n")).withColumn("pe", F.col("pe") / (F.col("n").cast("double") * F.col("n")))
    return both.select("n", F.round("po", 6).alias("p_o"), F.round("pe", 6).alias("p_e"), F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def kappa_label(k: Column) -> Column:
    return F.when(k < 0.2, "Poor").when(k < 0.4, "Fair").when(k < 0.6, "Moderate").when(k < 0.8, "Substantial").otherwise("Almost Perfect")


def kappa_table(pairs: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """field, n, kappa and label for each pair of columns, and a last row, mean, with the mean of the kappas."""
    rows = None
    for name, (a, b) in fields.items():
        own = cohen_kappa(pairs, a, b).select(F.lit(name).alias("field"), "n", "kappa")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.unionByName(rows.agg(F.lit("mean").alias("field"), F.max("n").alias("n"), F.round(F.avg("kappa"), 6).alias("kappa")))
    return rows.withColumn("label", kappa_label(F.col("kappa")))


def confusion_matrix(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b and n over the union of both raters' labels, zeros too."""
    p = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    labels = p.select(F.explode(F.array("a", "b")).alias("label")).distinct()
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    grid = labels.select(F.col("label").alias("a")).crossJoin(labels.select(F.col("label").alias("b")))  # label set squared
    return grid.join(p.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
