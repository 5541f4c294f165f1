"""Identity resolution and merging by provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of the sources and of the confidences of an affiliation.
SOURCE_RANK = {"eip_header_email": 7, "manual_R07": 6, "github_company_field": 3, "github_bio": 2, "forum_bio": 2, "lm_inferred": 1, "unknown": 0}
CONFIDENCE_RANK = {"Confirmed": 4, "Strong": 3, "Probable": 2, "LM_inferred": 1, "Unknown_checked": 1}


def rank(value: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.coalesce(value, F.lit(""))), F.lit(0))


def aliases(profiles: DataFrame, canonical: str, handles: list[str], pos: str) -> DataFrame:
    """alias and canonical, one row an alias: of several profiles the last by pos has it."""
    each = profiles.select(F.col(canonical).alias("canonical"), F.col(pos).alias("_pos"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(h).cast("string") for h in handles])))).alias("alias"))
    return each.filter("alias <> ''").groupBy("alias").agg(F.max_by("canonical", "_pos").alias("canonical"))


def canonical(rows: DataFrame, handle: str, alias_table: DataFrame) -> DataFrame:
    """rows with canonical: the profile's handle, or the row's own."""
    a = alias_table.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    return rows.join(a, F.col(handle).cast("string") == F.col("_alias"), "left").withColumn("canonical", F.coalesce("_canonical", F.col(handle).cast("string"))).drop("_alias", "_canonical")


def same_name(a: DataFrame, b: DataFrame, name_a: str, name_b: str, least: int = 4) -> DataFrame:
    """Pairs with equal names (trimmed, lower case) of at least so many letters."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    left = a.withColumn("_name", norm(name_a)).filter(F.length("_name") >= least)
    return left.join(b.withColumn("_name", norm(name_b)), "_name")


def best_entry(entries: DataFrame, handle: str, source: str, confidence: str, pos: str) -> DataFrame:
    """One entry for each handle (lower case): by rank of source, then of confidence; the first of equals."""
    w = Window.partitionBy("_handle").orderBy(F.desc(rank(F.col(source), SOURCE_RANK)), F.desc(rank(F.col(confidence), CONFIDENCE_RANK)), pos)
    return entries.withColumn("_handle", F.lower(F.col(handle))).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def majority(rows: DataFrame, key: str, label: str, pos: str) -> DataFrame:
    """The most frequent label of each key; of equals, the one seen first."""
    n = rows.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return n.groupBy(key).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias(label))


def count_map(rows: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """Counts of each label by key, as a map in order of the labels."""
    n = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias(name))  # one entry for each label of a closed vocabulary


def label_summary(rows: DataFrame, key: str, label: str, pos: str) -> DataFrame:
    """key, n, counts (a map in order of the labels) and top (the most frequent label; of equals the one seen first), from one pass: labels of a closed vocabulary."""
    t = rows.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    each = F.sort_array(F.collect_list(F.struct(label, "n", (-F.col("first")).alias("rank"))))
    a = t.groupBy(key).agg(F.sum("n").alias("n"), each.alias("each"))
    best = F.array_max(F.transform("each", lambda e: F.struct(e["n"], e["rank"], e[label].alias("label"))))
    return a.select(key, "n", F.map_from_entries(F.transform("each", lambda e: F.struct(e[label], e["n"]))).alias("counts"), best["label"].alias("top"))


def map_text(m: Column) -> Column:
    """k:v; k:v"""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "; ")


def lookup(profiles: DataFrame, key: str, handles: list[str], entries: DataFrame) -> DataFrame:
    """profiles with the entry (of best_entry) that their handles find first, in the order given and any case; found_by is the handle's place, from 1."""
    each = profiles.select(key, F.posexplode(F.array(*[F.lower(F.col(h).cast("string")) for h in handles])).alias("_k", "_handle")).filter("_handle <> ''")
    e = entries.select("_handle", F.struct(*[c for c in entries.columns if c != "_handle"]).alias("_entry"))
    first = each.join(e, "_handle").groupBy(key).agg(F.min_by("_entry", "_k").alias("_entry"), (F.min("_k") + 1).cast("int").alias("found_by"))
    out = profiles.join(first, key, "left")
    return out.select(*profiles.columns, *[F.col(f"_entry.{c}").alias(c) for c in entries.columns if c not in ("_handle", *profiles.columns)], "found_by")
