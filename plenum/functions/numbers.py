"""Densities, histograms and drawing sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reflected_kde(df: DataFrame, key: str, value: str, grid: list[float], bandwidth: float) -> DataFrame:
    """Gaussian density of value at each grid point, mirrored at 0 and doubled; the bandwidth is a share of the sample's standard deviation.

    The grid is a literal, so each row is expanded by its length, and sums are taken before the shuffle.
    """
    h = df.groupBy(key).agg((bandwidth * F.stddev_samp(value)).alias("h"), F.count(value).alias("n"))
    each = df.join(F.broadcast(h), key).select(key, "h", "n", F.col(value).alias("x"), F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("grid"))
    bump = lambda d: F.exp(-0.5 * F.pow(d / F.col("h"), F.lit(2)))
    total = F.sum(bump(F.col("grid") - F.col("x")) + bump(F.col("grid") + F.col("x")))
    return each.groupBy(key, "grid").agg(F.round(2 * total / (2 * F.max("n") * F.max("h") * math.sqrt(2 * math.pi)), 6).alias("density"))


def histogram(df: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """Rows in each of equal-width bins between the least and the greatest value of all keys; the last bin is closed."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    return df.crossJoin(F.broadcast(bounds)).groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))  # one row of bounds


def node_size(count: Column, base: int = 8, per: int = 5, most: int = 60) -> Column:
    return F.greatest(F.lit(10), F.least(F.lit(most), base + F.floor(count / per))).cast("int")


def edge_width(weight: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(8.0), 1 + F.log2(weight + 1)))


def share_width(weight: Column, most: Column) -> Column:
    """Width by the weight's logarithm as a share of the greatest weight's."""
    return F.greatest(F.lit(1.5), F.least(F.lit(12.0), 1.5 + 10.5 * F.log2(weight + 1) / F.log2(most + 1)))
