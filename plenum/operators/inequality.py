"""Inequality, diversity and divergence over long (actor, theme) counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.storage import cut, partitions


def gini(df: DataFrame, value: str, keys: list[str] | None = None, zeros: Column | None = None, ranges: bool = False) -> DataFrame:
    """keys and gini of value; 0 for groups without a positive sum. zeros: further zero values of a group.

    Equal values are counted first, so one task ranks a group's distinct values and not its rows. ranges: for groups of very
    many distinct values, which are ranked range by range.
    """
    keys = keys or []
    h = df.groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    past = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if ranges:
        h = cut(h.repartitionByRange(partitions(df.sparkSession), *keys, "x").withColumn("_range", F.spark_partition_id()))
        starts = h.groupBy(*keys, "_range").agg(F.sum("c").alias("c")).select(*keys, "_range", past(Window.partitionBy(*keys).orderBy("_range")).alias("_start"))  # a row for each range of a group
        h = h.withColumn("r", past(Window.partitionBy(*keys, "_range").orderBy("x"))).join(starts, [*keys, "_range"]).withColumn("r", F.col("r") + F.col("_start"))
    else:
        h = h.withColumn("r", past(Window.partitionBy(*keys).orderBy("x")))
    extra = F.lit(0) if zeros is None else zeros
    if zeros is not None:
        h = h.withColumn("z", zeros)
        extra = F.max("z")
    n = F.sum("c") + extra
    # The ranks of x are r + z + 1 ... r + z + c: their weights 2i - n - 1 add up to c (2 (r + z) + c - n).
    top = F.sum(F.col("x") * F.col("c") * (2 * F.col("r") + F.col("c"))) + F.sum(F.col("x") * F.col("c")) * (2 * extra - n)
    total = F.sum(F.col("x") * F.col("c"))
    return h.groupBy(*keys).agg(F.when(total > 0, top / (n * total)).otherwise(0.0).alias("gini"))


def entropy(share: Column) -> Column:
    """An aggregate: Shannon entropy in bits of a group's shares."""
    return F.coalesce(-F.sum(F.when(share > 0, share * F.log2(share))), F.lit(0.0))


def hhi(share: Column) -> Column:
    """An aggregate: sum of squared shares."""
    return F.sum(share * share)


def actor_theme_counts(rows: DataFrame, keys: list[str] = ["case_id"]) -> DataFrame:  # noqa: B006
    """Records by keys, actor and theme, in long form."""
    return rows.groupBy(*keys, "actor", "theme").agg(F.count("*").alias("n"))


def actor_diversity(rows: DataFrame) -> DataFrame:
    """For each case and actor: comments, themes, entropy, Gini over all themes of the case (zeros too) and the first of the largest themes."""
    counts = actor_theme_counts(rows)
    themes = counts.groupBy("case_id").agg(F.countDistinct("theme").alias("of"))
    w = Window.partitionBy("case_id", "actor")
    c = counts.withColumn("total", F.sum("n").over(w)).withColumn("i", F.row_number().over(w.orderBy("n", F.desc("theme"))))
    c = c.join(F.broadcast(themes), "case_id")  # one row for each case
    k, share = F.count("*"), F.col("n") / F.col("total")
    rank = 2 * F.sum(F.col("i") * F.col("n")) + F.sum("n") * (2 * (F.max("of") - k) - F.max("of") - 1)
    return c.groupBy("case_id", "actor").agg(
        F.sum("n").alias("n_comments"), k.alias("n_themes"), F.round(entropy(share), 6).alias("entropy"), F.round(rank / (F.max("of") * F.sum("n")), 6).alias("gini"), F.max_by("theme", "i").alias("top_theme"),
    )


def theme_concentration(rows: DataFrame) -> DataFrame:
    """For each case and theme: comments, active actors, Gini over the active actors and HHI."""
    counts = actor_theme_counts(rows)
    w = Window.partitionBy("case_id", "theme")
    c = counts.withColumn("total", F.sum("n").over(w))
    agg = c.groupBy("case_id", "theme").agg(F.sum("n").alias("n_comments"), F.count("*").alias("n_actors"), F.round(hhi(F.col("n") / F.col("total")), 4).alias("hhi"))
    return agg.join(gini(counts, "n", ["case_id", "theme"]), ["case_id", "theme"]).withColumn("gini_actors", F.round("gini", 6)).drop("gini")


def divergence_table(counts: DataFrame, topic: str, a: str, b: str, eps: float = 1e-10) -> DataFrame:
    """counts: topic and the counts a and b. Shares in percent are rounded to two places, and the divergence is that of the rounded ones."""
    whole = Window.partitionBy()  # a row for each topic
    t = counts.select(F.col(topic).alias("topic"), F.col(a).alias("n_a"), F.col(b).alias("n_b"))
    for s in "ab":
        t = t.withColumn(f"pct_{s}", F.round(100.0 * F.col(f"n_{s}") / F.sum(f"n_{s}").over(whole), 2))
        t = t.withColumn(f"_{s}", F.col(f"pct_{s}") / 100 + eps)
    for s in "ab":
        t = t.withColumn(f"p_{s}", F.col(f"_{s}") / F.sum(f"_{s}").over(whole))
    mid = (F.col("p_a") + F.col("p_b")) / 2
    t = t.withColumn("kl_a", F.col("p_a") * F.log(F.col("p_a") / mid)).withColumn("kl_b", F.col("p_b") * F.log(F.col("p_b") / mid))
    t = t.withColumn("js_contribution", (F.col("kl_a") + F.col("kl_b")) / 2).withColumn("abs_diff", F.abs(F.col("pct_a") - F.col("pct_b")))
    return t.drop("_a", "_b").withColumn("js_total", F.sum("js_contribution").over(whole))


def divergence_summary(divergence: DataFrame, k: int = 5) -> DataFrame:
    """One row: the divergence, the topics, and the k that add most to it as topic:contribution, the largest first."""
    top = divergence.orderBy(F.desc("js_contribution"), "topic").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.round("js_contribution", 6)).alias("c"), F.col("topic").cast("string").alias("t")))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["t"], F.format_number(-x["c"], 6))), "; ")
    return divergence.agg(F.round(F.max("js_total"), 6).alias("js_total"), F.count("*").alias("topics")).crossJoin(top.select(text.alias("top")))  # one row each


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Shared and own keys of two sets, and the overlap coefficient (shared by the smaller set)."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    in_a, in_b = F.count("_a"), F.count("_b")
    shared = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return both.agg(shared.alias("n_shared"), (in_a - shared).alias("only_a"), (in_b - shared).alias("only_b"), F.round(shared / F.nullif(F.least(in_a, in_b), F.lit(0)), 6).alias("overlap"))
