"""Predicates and fallbacks on records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_bot(name: Column, names: set[str], suffixes: list[str]) -> Column:
    """A member of names, or one that ends as bots do."""
    found = name.isin(sorted(names)) if names else F.lit(False)
    for s in suffixes:
        found = found | name.endswith(s)
    return F.coalesce(found, F.lit(False))


def contains_name(name: Column, part: str) -> Column:
    """part anywhere, in lower case."""
    return F.coalesce(F.lower(name).contains(part), F.lit(False))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def long_enough(text: Column, least: int = 20) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= least


def vote_record(text: Column) -> Column:
    """At least 30 characters, and no short command."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(strip(t)) >= 30) & ~(t.startswith("/") & (F.length(t) < 20))


def truthy(c: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[truthy(v) for v in values])


def fold(value: Column, known: list[str], other: str = "Off-topic") -> Column:
    return F.when(value.isin(known), value).otherwise(other)
