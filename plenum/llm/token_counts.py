"""Exact length histogram: documents by encoded length, with suffix sums for every context limit.

Defined cases: a null or empty text has length 0; an empty table has an empty histogram, whose totals
are 0 and whose quantiles are null; rows are counted as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.tokenizing import default_path, encoder
from plenum.storage import cut

#: Lengths whose running sums one task takes.
SPAN = 256


def token_lengths(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """n_tokens of every row."""
    tokenizer = tokenizer or default_path()

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"n_tokens": [len(enc.ids(t)) // 4 for t in batch["t"]]}, dtype="int64")

    return docs.select(F.col(text_col).alias("t")).mapInPandas(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row for each length: n_docs of it, docs_le, docs_ge and tokens_ge (documents and tokens at lengths
    up to it, or from it), and truncated_tokens (the corpus with every document cut to it).

    Suffix sums are taken in spans of lengths, then over the spans: no task sees every length.
    """
    # Written, as the spans and the lengths within them both read it: texts are encoded once.
    h = cut(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("sd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("st"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = spans.select(
        "span",
        F.coalesce(F.sum("sd").over(after), F.lit(0)).alias("after_docs"), F.coalesce(F.sum("st").over(after), F.lit(0)).alias("after_tokens"),
        F.sum("sd").over(whole).alias("docs"), F.sum("st").over(whole).alias("tokens"),
    )
    own = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.join(sums, "span")
        .withColumn("docs_ge", F.col("after_docs") + F.sum("n_docs").over(own))
        .withColumn("tokens_ge", F.col("after_tokens") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(own))
        .select(
            "n_tokens", "n_docs", (F.col("docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"), "docs_ge", "tokens_ge",
            (F.col("tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        )
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row, tokens: the corpus with every document cut to limit."""
    return histogram.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"))


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the smallest length that at least the share q of documents do not exceed."""
    least = F.greatest(F.lit(1), F.ceil(F.lit(q) * (F.col("docs_le") + F.col("docs_ge") - F.col("n_docs"))))
    return histogram.filter(F.col("docs_le") >= least).agg(F.min("n_tokens").alias("n_tokens"))
