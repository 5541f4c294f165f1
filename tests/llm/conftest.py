from __future__ import annotations

import random

import pytest

WORDS = {
    "en": "the of and to in is that it was for on with as are at be by this from or which not have has but all their there been more one would".split(),
    "fr": "le la les de des du et est une que qui dans pour pas sur avec plus par ce il elle nous vous être avoir fait été même aussi très".split(),
    "de": "der die das und ist nicht ein eine mit auf für von dem den des sich auch als wie nach über wir sie haben werden können müssen große".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "", rng.choice(WORDS[lang])]) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "\n" if k % 23 == 22 else "") for k, w in enumerate(words))


@pytest.fixture(scope="session", name="prose")
def prose_():
    return prose


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, repeats, other scripts."""
    rows = [(k, prose(lang := ["en", "fr", "de"][k % 3], 60 + 7 * k % 120, k), lang, f"s{k % 4}") for k in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \t\n", "fr", None), (103, "12345 !!", None, "s1"), (104, "a", "en", "s1")]
    rows += [(105, rows[5][1], "de", "s2"), (106, rows[5][1] + " extra", "de", "s2"), (105, rows[5][1], "de", "s2"), (-7, rows[6][1], "en", "s3")]
    rows += [(107, prose("en", 40_000, 7), "en", "s0"), (108, "naïve Ünïcödé ΣΑΣ 中文 é <|endoftext|> don't\x1cx y", "fr", "s0"), (2**60, "x y z " * 400, "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    """With columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumn("score", F.lit("mine")).withColumn("fingerprint", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("host", F.lit("h")).withColumn("u", F.lit(0)).withColumn("k", F.lit("k")).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
