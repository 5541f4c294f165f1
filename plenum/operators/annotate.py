"""Model stages over records: batches, retries, errors as rows, and resume by what is written.

The model is a function from a list of texts to a list of answers. Offline a rule answers; a client of an
API takes its place by the same signature.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.text import ANNOTATION, parse_annotation
from plenum.sources.files import exists

Model = Callable[[list[str]], list[str]]

#: Records of a batch, and characters of a record that a batch shows.
BATCH, SHOWN = 15, 800
ATTEMPTS, LONGEST_WAIT = 6, 60.0


def with_retry(call: Model, attempts: int = ATTEMPTS, longest: float = LONGEST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Model:
    """call, tried again with doubled waits; empty answers when it is given up."""

    def tried(texts: list[str]) -> list[str]:
        for k in range(attempts):
            try:
                return call(texts)
            except Exception:  # noqa: BLE001  whatever a client raises
                if k + 1 < attempts:
                    sleep(min(longest, 2.0**k))
        return [""] * len(texts)

    return tried


def rule_model(texts: list[str]) -> list[str]:
    """A deterministic stand-in: the stance by words, the point by the first ones."""
    out = []
    for t in texts:
        low = t.lower()
        stance = "Oppose" if "not" in low.split() else "Support" if "good" in low or "thanks" in low else "Modify" if "should" in low else "Neutral"
        kind = "Technical" if any(c.isdigit() for c in t) else "Process"
        out.append(json.dumps({"stakeholder_institution": None, "argument_type": kind, "stance": stance, "consensus_signal": "None", "key_point": " ".join(t.split()[:8])}))
    return out


def answers(records: DataFrame, id_col: str, text_col: str, model: Model = rule_model, batch: int = BATCH, shown: int = SHOWN) -> DataFrame:
    """record_id, raw and failure: what the model says to each record, in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                try:
                    said, failure = model([t[:shown] for t in part["t"]]), None
                except Exception as e:  # noqa: BLE001  an error is a row
                    said, failure = [None] * len(part), f"{type(e).__name__}: {e}"
                said = [*said, *[None] * len(part)][: len(part)]
                yield pd.DataFrame({"record_id": part["k"], "raw": said, "failure": failure})

    rows = records.select(F.col(id_col).cast("string").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "record_id string, raw string, failure string")


def annotate(records: DataFrame, id_col: str, text_col: str, model: Model = rule_model) -> DataFrame:
    """record_id, annotation and annotation_error."""
    return answers(records, id_col, text_col, model).select("record_id", parse_annotation(F.col("raw"), F.col("failure")).alias("p")).select("record_id", "p.annotation", "p.annotation_error")


def pending(records: DataFrame, id_col: str, done: DataFrame | None, retry_failed: bool = True) -> DataFrame:
    """Records that are not done yet; failed ones come again."""
    if done is None:
        return records
    ok = done.filter("annotation_error is null") if retry_failed else done
    return records.join(ok.select(F.col("record_id").alias("_done")), F.col(id_col).cast("string") == F.col("_done"), "left_anti")


def first(records: DataFrame, pos: str, n: int) -> DataFrame:
    """The first n records in the order of ingest: what a run with a limit takes."""
    return records.orderBy(pos).limit(n)


def stratified_sample(records: DataFrame, stratum: str, sizes: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """Rows drawn without replacement, as many of each stratum as sizes says or as there are, in the order of a seeded hash of the key. Strata without a size give none."""
    draw = F.struct(F.xxhash64(key, F.lit(seed)), F.col(key))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(stratum))
    # The smallest hashes of a stratum are found map side, so that no task sorts a whole stratum.
    kept = records.filter(F.col(stratum).isin(list(sizes))).select(F.col(stratum).alias("_stratum"), draw.alias("_draw"))
    from pyspark.sql import Window

    w = Window.partitionBy("_stratum").orderBy("_draw")
    least = kept.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max(sizes.values())).withColumnRenamed("_stratum", stratum).filter(F.col("_rn") <= size)
    return records.join(F.broadcast(least.select(F.col("_draw")[key].alias(key))), key, "left_semi")  # as many rows as the sizes add up to


def run_stage(spark: SparkSession, records: DataFrame, id_col: str, text_col: str, path: str, model: Model = rule_model) -> DataFrame:
    """Annotate what the table at path lacks and append it there, a folder for each attempt; the newest row of each record counts.

    What is done is told by ids and errors alone; the annotations are read only by who uses the result.
    """
    done, number = None, 0
    if exists(spark, f"{path}/attempt=*"):
        done = spark.read.parquet(path).select("record_id", "annotation_error")
        number = spark.read.parquet(path).agg(F.max("attempt")).first()[0]  # the folders' names
    new = annotate(pending(records, id_col, done), id_col, text_col, model).withColumn("attempt", F.lit(number + 1))
    new.write.mode("append").partitionBy("attempt").parquet(path)
    every = spark.read.schema(f"record_id string, annotation struct<{ANNOTATION.replace(' string', ': string')}>, annotation_error string, attempt int").parquet(path)
    return every.groupBy("record_id").agg(F.max_by(F.struct("annotation", "annotation_error"), "attempt").alias("a")).select("record_id", "a.*")


def aggregate(codes: DataFrame, code: str, model: Model, most: int = 300, seed: int = 42) -> dict[str, list[str]]:
    """Themes by label, each with its codes: what the model makes of the distinct codes, at most so many by a seeded hash. An answer that is no JSON gives no theme."""
    rows = codes.filter(F.coalesce(code, F.lit("")) != "").select(F.col(code).alias("c")).distinct().orderBy(F.xxhash64("c", F.lit(seed)), "c").limit(most)
    seen = sorted(r["c"] for r in rows.collect())  # at most `most` rows
    try:
        found = json.loads(with_retry(model)([json.dumps(seen)])[0])
    except (json.JSONDecodeError, IndexError):
        return {}
    return {str(k): [str(c) for c in v] for k, v in found.items()} if isinstance(found, dict) else {}


def review(clusters: dict[str, list[str]], model: Model) -> list[dict]:
    """The codebook: entries with theme_id (T01 ... by their place where the model names none), label, description and codes. An answer that is no JSON list gives none."""
    try:
        found = json.loads(with_retry(model)([json.dumps(clusters, ensure_ascii=False)])[0])
    except (json.JSONDecodeError, IndexError):
        return []
    entries = [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []
    return [{"theme_id": e.get("theme_id") or f"T{k:02d}", "label": e.get("label", ""), "description": e.get("description", ""), "codes": list(e.get("codes", []))} for k, e in enumerate(entries, 1)]


def group_by_first_part(prompts: list[str]) -> list[str]:
    """A stand-in for the model that groups codes: by what stands before the slash."""
    out = []
    for p in prompts:
        themes: dict[str, list[str]] = {}
        for c in json.loads(p):
            themes.setdefault(c.split("/")[0], []).append(c)
        out.append(json.dumps(themes))
    return out


def keep_in_order(prompts: list[str]) -> list[str]:
    """A stand-in for the model that reviews: themes in the order of their labels, without ids."""
    return [json.dumps([{"label": k, "description": f"{len(v)} codes", "codes": v} for k, v in sorted(json.loads(p).items())]) for p in prompts]


def themes_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """theme_id, label, description and codes of a codebook."""
    return spark.createDataFrame([(e["theme_id"], e["label"], e["description"], e["codes"]) for e in entries], "theme_id string, label string, description string, codes array<string>")


def assign(records: DataFrame, id_col: str, code: str, book: DataFrame) -> DataFrame:
    """record_id, theme_id and confidence: the theme (of themes_table) that has a record's code; what has no theme is Unclassified, with low confidence."""
    b = book.select("theme_id", F.explode("codes").alias("_code")).groupBy("_code").agg(F.min("theme_id").alias("theme_id"))
    j = records.join(F.broadcast(b), F.col(code) == F.col("_code"), "left")  # at most 300 rows
    return j.select(F.col(id_col).cast("string").alias("record_id"), F.coalesce("theme_id", F.lit("Unclassified")).alias("theme_id"), F.when(F.col("theme_id").isNull(), "low").otherwise("high").alias("confidence"))
