"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Normalised lines (lower case, digits as 0, single spaces) are hashed. A line whose number of distinct
documents on a host exceeds LINE_DOCS is removed, however long it is and however many documents the host
has; a document that keeps less than KEEP_SHARE of its words is depleted and rejected. Documents are
distinct by their texts: repetition of a whole text is the matter of deduplication, which could keep none of a
group of copies that had depleted each other here. copies=True counts every document id instead.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its
own; rows are judged as often as they occur; a line of any length is one hash; an empty table gives no row;
extra columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.storage import cut, free_names

LINE_DOCS = 20
KEEP_SHARE = 0.5

#: Names of what base_counts computes.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def spaced(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x09-\\x0D]", " "), " {2,}", " "))


def normalised(text: Column) -> Column:
    """Lower case, digits as 0, and one space for white space but line ends: a whole text, or a line, whose end spaces are still to go."""
    low = F.lower(text)
    plain = F.when(low.rlike("[\\x09\\x0B-\\x0D]"), F.translate(low, "\t\u000b\f\r", "    ")).otherwise(low)
    return F.regexp_replace(F.regexp_replace(plain, "[1-9]", "0"), " {2,}", " ")


def base_counts(rows: DataFrame) -> DataFrame:
    """rows (with a column text, without those that come) with _spaced, _words and the counts, all long."""
    df = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_spaced", spaced(F.col("text")))
    df = df.withColumn("_words", F.when(F.length("_spaced") > 0, F.split("_spaced", " ")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", (F.length("_spaced") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    # Windows by hash, within one text.
    w = F.col("_words")
    window = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    df = df.withColumn("_windows", window).withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    h = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), h).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("_sorted")
    same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
    at = F.sort_array(F.transform(F.filter("_sorted", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("_at", at).drop("_windows", "_repeats", "_sorted")
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))["n"]
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_at")


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A narrow row for each document: doc_id, host, a hash of the text, the base counts, and each line's hash and number of words."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    # The text is normalised whole; a line end parts neither words nor letters that change with their neighbours.
    lines = F.filter(F.transform(F.split(normalised(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return base_counts(named).select("doc_id", "host", "hash", *COUNTS, F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), words(x).alias("words"))).alias("lines"))


def frequent_lines(lines: DataFrame, min_docs: int | None = None, copies: bool = False) -> DataFrame:
    """host and line of each line above the limit."""
    if copies:
        ids = lines.groupBy("host", "hash", "doc_id").agg(F.first("lines").alias("lines"))
        texts = ids.groupBy("host", "hash").agg(F.first("lines").alias("lines"), F.count("*").alias("of"))
    else:
        texts = lines.groupBy("host", "hash").agg(F.first("lines").alias("lines")).withColumn("of", F.lit(1))
    each = texts.select("host", "of", F.explode(F.array_distinct("lines")).alias("l"))
    counts = each.groupBy("host", F.col("l.line").alias("line")).agg(F.sum("of").alias("docs"))
    return counts.filter(F.col("docs") > (LINE_DOCS if min_docs is None else min_docs)).select("host", "line")


def judge(lines: DataFrame, frequent: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """lines' documents with n_removed_words, gone (the hashes of the lines removed; null if none), base_failed and kept."""
    lines = lines.withColumn("_row", F.monotonically_increasing_id())  # lines are written: the numbers hold
    each = lines.select("_row", "host", F.explode("lines").alias("l"))
    f = frequent.select(F.col("host").alias("fhost"), F.col("line").alias("fline"))
    hit = each.join(f, (F.col("l.line") == F.col("fline")) & F.col("host").eqNullSafe(F.col("fhost")))
    removed = hit.groupBy("_row").agg(F.sum("l.words").alias("n_removed_words"), F.collect_set("l.line").alias("gone"))
    n = F.col("n_words")
    base_failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    df = lines.drop("lines").join(removed, "_row", "left")
    df = df.withColumn("n_removed_words", F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")).withColumn("base_failed", base_failed)
    return df.withColumn("kept", ~F.col("base_failed") & (n - F.col("n_removed_words") >= keep_share * n)).drop("_row")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies: bool = False) -> DataFrame:
    """judge's rows for every row of docs."""
    lines = cut(document_lines(docs, id_col, text_col, host_col))
    return judge(lines, cut(frequent_lines(lines, copies=copies)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies: bool = False) -> DataFrame:
    """doc_id, the base counts, n_removed_words, base_failed and kept of every row."""
    return verdicts(docs, id_col, text_col, host_col, copies).select("doc_id", *COUNTS, "n_removed_words", "base_failed", "kept")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies: bool = False) -> DataFrame:
    """The kept rows of docs; their texts lose the lines above the limits. Texts without such lines stay as they are.

    Verdicts are joined by (id, host, text hash): equal rows have equal verdicts.
    """
    i, host, text_hash, gone = free_names(docs, "id", "host", "hash", "gone")
    kept = verdicts(docs, id_col, text_col, host_col, copies).filter("kept")
    kept = kept.groupBy(F.col("doc_id").alias(i), F.col("host").alias(host), F.col("hash").alias(text_hash)).agg(F.first("gone").alias(gone))
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(host_col).cast("string").eqNullSafe(F.col(host)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text_hash))
    line = lambda x: F.trim(normalised(x))
    stay = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(line(x))) | (line(x) == ""))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))
    return docs.join(kept, same).withColumn(text_col, text).drop(i, host, text_hash, gone)
