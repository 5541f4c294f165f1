"""A corpus pipeline of five of the llm operators; each stage works on all that the one before it kept.

Defined cases: an empty table, or a stage that keeps nothing, gives no row; rows without an id or with a repeated one
are documents like any other; equal rows are one document after the third stage; texts of any length are
worked on whole; extra columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import decontaminate, language_id, packing, quality, simhash
from plenum.storage import discard, free_names, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents in no known language (no letter, or no text) go."""
    train, _ = language_id.training_rows(docs)
    return docs.filter(language_id.identify(docs, language_id.fit(train))["lang_pred"] != language_id.UNKNOWN)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: lines above the limits are removed, failing and depleted documents go."""
    return quality.clean(docs).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-deduplication: one row of each component stays, that of the least id; a row without an id stays if no row of its component has one. Repeated ids of different texts are different documents."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with an item's window go."""
    (found,) = free_names(docs, "found")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), found).filter(~F.col(found)["contaminated"]).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of every document and their places in sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The language model, the fingerprints and the tokenizer are not expressible in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written and read again for the next; what a stage has read goes when it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    root = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{root}/{k}-{name}")
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
