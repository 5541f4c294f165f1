"""Time bins, phases, peaks and cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def parse_ts(text: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.try_to_timestamp(text)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of the clock that ts shows, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def phase(ts: Column, phases: list[tuple[str, str, str]]) -> Column:
    """Name of the phase [start, end) that ts lies in; null outside."""
    out = F.lit(None).cast("string")
    for name, start, end in reversed(phases):
        out = F.when((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")), name).otherwise(out)
    return out


def anchored_bins(rows: DataFrame, key: str, ts: str, category: str, days: int) -> DataFrame:
    """Counts and within-bin shares by bins of days from each key's earliest row. Empty bins are left out."""
    start = rows.groupBy(key).agg(F.min(ts).alias("_start"))  # a row for each case
    at = F.floor((micros(F.col(ts)) - micros(F.col("_start"))) / F.lit(days * DAY)).cast("long")
    n = rows.filter(F.col(ts).isNotNull()).join(F.broadcast(start), key).groupBy(key, at.alias("bin"), category).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(key, "bin")), 6))


def weekly_peak(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The busiest week (Monday to Sunday) of each key, the first of equals, with its rows; and the number of weeks spanned."""
    weeks = rows.filter(F.col(ts).isNotNull()).groupBy(key, F.to_date(F.date_trunc("week", ts)).alias("week")).agg(F.count("*").alias("n"))
    agg = weeks.groupBy(key).agg(F.max(F.struct("n", -F.unix_date("week"))).alias("m"), F.min("week").alias("first"), F.max("week").alias("last"))
    return agg.select(key, F.date_from_unix_date((-F.col("m").getField("col2")).cast("int")).cast("string").alias("peak_week"), F.col("m.n").alias("peak_n"), (F.datediff("last", "first") / 7 + 1).cast("long").alias("weeks"))


def elbow_cutoff(counts: DataFrame, value: str, tie: str, floor: int = 20, cap: int = 80) -> DataFrame:
    """One row, cutoff: the rank in floor..cap after which the counts, from the largest down, drop by the largest share; the first of equal drops."""
    top = counts.orderBy(F.desc(value), tie).limit(cap + 1)
    w = Window.orderBy(F.desc(value), tie)  # at most cap + 1 rows
    r = top.select(F.row_number().over(w).alias("rank"), F.col(value).alias("c"), F.lead(value).over(w).alias("next"))
    drop = r.filter(F.col("next").isNotNull() & (F.col("rank") >= floor) & (F.col("rank") <= cap)).withColumn("drop", (F.col("c") - F.col("next")) / F.col("c"))
    n = counts.agg(F.count("*").alias("of"))
    best = drop.agg(F.max(F.struct("drop", (-F.col("rank")).alias("r"))).alias("m"))
    return best.crossJoin(n).select(F.least(F.lit(cap), F.coalesce(-F.col("m.r"), F.col("of").cast("int"))).cast("long").alias("cutoff"))
