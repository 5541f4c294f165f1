"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import decontaminate, divergence, hard_negatives, html_extract, language_id, mixing, oracles, packing, quality, sharding, simhash, token_counts, token_files, toxicity
from plenum.storage import scratch, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_to_target(table(spark, sf_dir, "documents"), shards=8)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(docs.filter(~held).select(F.col("doc_id").alias("id"), "text"), labels)
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.toxicity(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.LIMIT).cast("int"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train, held = language_id.training_rows(docs)
    found = language_id.identify(docs, language_id.fit(train))
    return docs.select("doc_id", held.alias("held_out"), found.alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits_per_byte")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "c")
    return found.select("doc_id", "c.n_words", "c.n_hit", "c.n_items", "c.items_sha256", "c.contaminated")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_source_mixing": op11_source_mixing,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_html_extraction": oracles.ARTICLES,
    "op2_kd_sharding": oracles.SHARDING,
    "op4_quality_rules": oracles.QUALITY,
    "op6_decontamination": oracles.DECONTAMINATION,
    "op7_simhash": oracles.SIMHASH,
    "op11_source_mixing": oracles.MIXING,
    "op12_source_divergence": oracles.DIVERGENCE,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
