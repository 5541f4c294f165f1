"""Points of time in intervals that stand in a table: equal joins on bins of time, then the exact bounds.

An interval stands in the bins that it covers, of a width at which these are SPREAD at most: the finest for short ones, SPREAD times as wide
for each step longer. A point looks into its bin of each width that any interval has. Bins with many points are split by a hash,
and their intervals go to each part. So neither a long interval nor a busy hour is one task's, and nothing is
compared with everything. Where keys are given, rows of a key with few points meet by the key alone: a row is shuffled once and stands in no bin.

Defined cases: intervals are half-open, [start, end); a missing start or end is open; intervals may overlap, and a point has a row for each;
one that ends where it starts, or before, holds nothing; points without a time, or in no interval, have no row; with keys, rows meet only where these are equal and not
null; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.timebins import micros
from plenum.storage import cut, free_names

#: Bins that an interval stands in, at most (and one more at each end), and points of a bin that are one part's.
SPREAD, PART = 32, 100_000
#: The width of the finest bins, in microseconds.
FINEST = 3_600_000_000
#: Points of a key up to which its rows meet without bins.
FEW = 256


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, by: list[str] = [], finest: int = FINEST, part: int = PART, few: int = FEW) -> DataFrame:  # noqa: B006
    """All columns of points and of intervals (by once), a row for each interval that a point lies in. The tables share no column names but by."""
    names = free_names(points.join(intervals.drop(*by), F.lit(False)), "x", "level", "width", "bin", "salt", "parts", "lo", "hi")
    x, lo, hi = names[0], *names[-2:]
    p = points.withColumn(x, micros(F.col(at))).filter(F.col(x).isNotNull())
    span = p.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    first, last = (span["a"], span["b"]) if span["a"] is not None else (0, 0)
    covered = intervals.withColumn(lo, F.coalesce(F.greatest(micros(F.col(start)), F.lit(first)), F.lit(first))).withColumn(hi, F.coalesce(F.least(micros(F.col(end)), F.lit(last + 1)), F.lit(last + 1)))
    covered = covered.filter(F.col(lo) < F.col(hi))
    within = (F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi))
    out = [*by, *[c for c in [*points.columns, *intervals.columns] if c not in by]]
    if not by:
        return _binned(p, covered, by, finest, part, names).filter(within).select(out)
    crowded = cut(p.dropna(subset=by).groupBy(*by).agg(F.count("*").alias(names[5])).filter(F.col(names[5]) > few).select(*by))
    if crowded.isEmpty():
        return p.join(covered, by).filter(within).select(out)
    direct = p.join(crowded, by, "left_anti").join(covered, by).filter(within).select(out)
    return direct.unionByName(_binned(p.join(crowded, by, "left_semi"), covered.join(crowded, by, "left_semi"), by, finest, part, names).filter(within).select(out))


def _binned(p: DataFrame, covered: DataFrame, by: list[str], finest: int, part: int, names: list[str]) -> DataFrame:
    """Points and intervals that share a bin, and the keys."""
    (x, level, width, bin_, salt, parts, lo, hi), columns = names, p.columns
    step = F.greatest(F.lit(0), F.ceil(F.log((F.col(hi) - F.col(lo)) / finest) / F.log(F.lit(float(SPREAD)))) - 1)
    covered = cut(covered.withColumn(level, step.cast("int")))
    levels = sorted(r[0] for r in covered.select(level).distinct().collect())  # a few widths
    wide: Column = F.lit(finest)
    for k in levels:
        wide = F.when(F.col(level) == k, F.lit(finest * SPREAD**k)).otherwise(wide)
    covered = covered.withColumn(width, wide)
    covered = covered.withColumn(bin_, F.explode(F.sequence(F.floor(F.col(lo) / F.col(width)), F.floor((F.col(hi) - 1) / F.col(width)))))
    looks = F.array(*[F.struct(F.lit(k).alias(level), F.floor(F.col(x) / (finest * SPREAD**k)).alias(bin_)) for k in levels]) if levels else F.array().cast("array<struct<level:int,bin:bigint>>")
    p = p.withColumn("_look", F.explode(looks)).withColumn(level, F.col("_look")[level if levels else "level"]).withColumn(bin_, F.col("_look")[bin_ if levels else "bin"]).drop("_look")
    keys = [*by, level, bin_]
    busy = cut(p.groupBy(*keys).agg(F.ceil(F.count("*") / part).cast("int").alias(parts)).filter(F.col(parts) > 1))
    one = F.coalesce(F.col(parts), F.lit(1))
    p = p.join(busy, keys, "left").withColumn(salt, F.pmod(F.xxhash64(*columns), one).cast("int")).drop(parts)
    covered = covered.join(busy, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), one - 1))).drop(parts)
    return p.join(covered, [*keys, salt])
