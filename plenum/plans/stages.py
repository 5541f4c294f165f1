"""A pipeline of named stages over tables: each runs when its inputs are there and its table is not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import annotate, identity, profiles
from plenum.sources.files import exists


@dataclass(frozen=True)
class Stage:
    name: str
    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]


def ordered(stages: list[Stage], given: set[str]) -> list[Stage]:
    """The stages so that each comes after those that make its inputs."""
    done, left, out = set(given), list(stages), []
    while left:
        ready = [s for s in left if set(s.inputs) <= done]
        if not ready:
            raise ValueError(f"no inputs for {', '.join(s.name for s in left)}")
        out += ready
        done |= {s.name for s in ready}
        left = [s for s in left if s not in ready]
    return out


def run_stages(spark: SparkSession, stages: list[Stage], root: str, again: set[str] = frozenset()) -> dict[str, DataFrame]:
    """Tables by name, under root. A table that is there is not made again, unless its stage or one before it is in `again`."""
    names = {n for s in stages for n in s.inputs} - {s.name for s in stages}
    tables = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    fresh = set(again)
    for s in ordered(stages, names):
        path = f"{root}/{s.name}"
        if s.name in fresh or fresh & set(s.inputs) or not exists(spark, f"{path}/_SUCCESS"):
            s.run(*[tables[n] for n in s.inputs]).write.mode("overwrite").parquet(path)
            fresh.add(s.name)
        tables[s.name] = spark.read.parquet(path)
    return tables


def _annotated(records: DataFrame) -> DataFrame:
    a = annotate.annotate(records, "record_id", "raw_text")
    return records.join(a, "record_id")


def _profiles(annotated: DataFrame, affiliations: DataFrame, alias_profiles: DataFrame) -> DataFrame:
    a = identity.aliases(alias_profiles, "canonical", ["canonical", "github_handle", "forum_handle"], "_pos")
    return profiles.rollup(identity.canonical(annotated, "author", a), affiliations)


#: records, affiliations and alias_profiles are given.
DISCOURSE = [
    Stage("annotated", ("records",), _annotated),
    Stage("profiles", ("annotated", "affiliations", "alias_profiles"), _profiles),
    Stage("category_counts", ("annotated",), lambda a: a.groupBy("_case", F.col("annotation.argument_type").alias("argument_type")).agg(F.count("*").alias("n"))),
]
