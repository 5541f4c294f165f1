"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of order 0 to 3 is counted. A byte costs -log2 of its share in
the longest context that has it, plus the cost of each escape on the way down (method C: an escape has
the weight of the number of distinct bytes of its context; no exclusions; order -1 is uniform over 256
bytes). The statistics are frozen, so the code length of a text is a sum over table look-ups; the
language with the shortest code wins.

The trees are kept as they were met: a row of costs for each string of bytes that some language has,
and a row of escapes for each context, found by hashing. A byte that no language has after its context
takes the escapes and goes one order down. Room grows with what the sample holds, not with the alphabet.

The trees are fitted on a sample of labelled rows of at most SAMPLE_DOCS whole texts a language (the
documented bound); every text is scored whole.

Defined cases: a null text, or one without a letter, gets "und" and score 0; without labelled
rows every text does; ties go to the first language by name; a row is scored as often as it occurs; a text
of any length is scored in slices; an empty table gives no row; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Labelled rows of each language that the model is fitted on.
SAMPLE_DOCS = 400
#: Bytes of the cost tables, which every worker holds; a fit that needs more is refused.
TABLE_LIMIT = 512 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Costs (bytes times languages) that are looked up at a time.
SLICE = 1 << 21
#: Byte that stands before a text.
START = 0


class Rows:
    """The numbers of 32-bit keys, by open addressing in a table that is at most a quarter full."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys.astype(np.uint32)
        todo, at = np.arange(len(keys)), self._home(self.keys)
        while len(todo):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.slots[at[taken]] = todo[taken]
            rest = np.ones(len(todo), bool)
            rest[taken] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for those that are not there."""
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero(out >= 0)
        todo = todo[self.keys[out[todo]] != keys[todo]]
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            own = self.slots[at]
            out[todo] = own
            rest = np.flatnonzero(own >= 0)
            rest = rest[self.keys[own[rest]] != keys[todo[rest]]]
            todo, at = todo[rest], at[rest]
        return out


class ContextTrees:
    """Costs in bits of bytes after contexts, a column for each language.

    cost[k]: of the strings of k + 1 bytes that some language has; escape[k]: of the contexts of k bytes, 0 where a
    language has not met one. Orders 0 and 1 are whole tables; rows[k] finds the others, and contexts finds those of order 3.
    """

    def __init__(self, languages: list[str], cost: list[np.ndarray], escape: list[np.ndarray], rows: dict[int, Rows], contexts: Rows | None):
        self.languages, self.cost, self.escape, self.rows, self.contexts = languages, cost, escape, rows, contexts

    @classmethod
    def of(cls, counts: pd.DataFrame) -> ContextTrees:
        """counts: lang, gram (four bytes as an integer, the first highest) and n."""
        languages = sorted(counts["lang"].unique())
        if not languages:
            return cls([], [], [], {}, None)
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(float)
        which = np.searchsorted(languages, counts["lang"].to_numpy())
        strings = {k: np.unique(gram & ((1 << 8 * (k + 1)) - 1)) for k in (2, 3)}
        of_context = {3: np.unique(gram >> 8)}
        strings |= {0: np.arange(1 << 8), 1: np.arange(1 << 16)}
        of_context |= {0: np.zeros(1, np.int64), 1: np.arange(1 << 8), 2: np.arange(1 << 16)}
        size = sum(map(len, strings.values())) + sum(map(len, of_context.values()))
        if size * len(languages) * 4 > TABLE_LIMIT:
            raise ValueError(f"the cost tables would take {size * len(languages) * 4} bytes; lower sample_docs or raise TABLE_LIMIT")
        cost = [np.zeros((len(strings[k]), len(languages)), np.float32) for k in range(4)]
        escape = [np.zeros((len(of_context[k]), len(languages)), np.float32) for k in range(4)]
        for j in range(len(languages)):
            own, m = gram[which == j], n[which == j]
            below = np.full(1, 8.0)
            for k in range(4):
                s = strings[k]
                seen = np.bincount(np.searchsorted(s, own & ((1 << 8 * (k + 1)) - 1)), m, len(s))
                context = np.searchsorted(of_context[k], s >> 8)
                total = np.bincount(context, seen, len(of_context[k]))
                distinct = np.bincount(context, seen > 0, len(of_context[k]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    out = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                    shorter = np.searchsorted(strings[k - 1], s & ((1 << 8 * k) - 1)) if k else np.zeros(len(s), np.int64)
                    level = np.where(seen > 0, -np.log2(seen / (total + distinct)[context]), out[context] + below[shorter])
                cost[k][:, j], escape[k][:, j] = level, out
                below = level
        return cls(languages, cost, escape, {k: Rows(strings[k]) for k in (2, 3)}, Rows(of_context[3]))

    def _costs(self, gram: np.ndarray, order: int = 3) -> np.ndarray:
        """A row for each string of four bytes, of which the last order bytes before the last are looked at."""
        string = gram & np.uint32((1 << 8 * (order + 1)) - 1)
        if order < 2:
            return self.cost[order][string]
        row = self.rows[order].find(string)
        out = self.cost[order][row]
        rest = np.flatnonzero(row < 0)
        if len(rest):
            context = string[rest] >> np.uint32(8)
            out[rest] = self._costs(gram[rest], order - 1)
            if order == 3:
                at = self.contexts.find(context)
                known = at >= 0
                out[rest[known]] += self.escape[3][at[known]]
            else:
                out[rest] += self.escape[order][context]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        joined = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts) or b"\0\0\0", np.uint8)
        starts = np.cumsum([0] + [len(t) + 3 for t in texts[:-1]])
        out = np.zeros((len(texts), len(self.languages)))
        step = max(4, SLICE // len(self.languages))
        for lo in range(3, len(joined), step):
            hi = min(len(joined), lo + step)
            s = joined[lo - 3 : hi].astype(np.uint32)
            cost = self._costs(s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:])
            cost[s[3:] == START] = 0  # the start is not coded
            first = int(np.searchsorted(starts, lo, "right")) - 1
            last = int(np.searchsorted(starts, hi, "left"))
            out[first:last] += np.add.reduceat(cost, np.maximum(starts[first:last] - lo, 0), axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rows = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        at = 0
        while self.languages and at < len(rows):
            chunk, size = [], 0
            while at < len(rows) and (not chunk or size < SLICE // len(self.languages)):
                chunk.append(prepared(texts[rows[at]]))
                size += len(chunk[-1])
                at += 1
            bits = self.bits(chunk)
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for j, k in enumerate(rows[at - len(chunk) : at]):
                lang[k], score[k], rate[k] = self.languages[best[j]], share[j], bits[j, best[j]] / max(1, len(chunk[j]))
        return pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": rate})


def prepared(text: str) -> bytes:
    """Lower case, as UTF-8, with the byte of the start left out."""
    return text.lower().encode("utf-8", "replace").replace(b"\0", b" ")


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            s = np.frombuffer(b"\0\0\0" + prepared(text), np.uint8).astype(np.int64)
            gram, n = np.unique(s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:], return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})


def sampled(train: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """lang and text of sample_docs rows of each language at most, by a hash of id and text; equal rows count once.

    So missing ids, or one id for all, draw as distinct ids do, and no language of the rows is lost.
    """
    draw = F.xxhash64(F.col("id"), F.col("text"), F.lit("sample"))
    train = train.filter("lang is not null and text is not null and length(text) > 0").withColumn("draw", draw)
    # A row for each language: the label set bounds it.
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.countDistinct("draw").alias("n")).collect()}
    if not sizes:
        return train.select("lang", "text")
    # Twice the rows that are taken, or all, then the first of them: ranks are told among few rows.
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * (sample_docs + 20) / n))])
    even = F.pmod(F.col("draw"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    some = train.filter(even < F.element_at(share, F.col("lang"))).groupBy("lang", "draw").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= sample_docs).select("lang", "text")


def fit(train: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ContextTrees:
    """train: id, text and lang of labelled rows, of which a sample is taken."""
    counts = sampled(train, sample_docs).mapInPandas(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return ContextTrees.of(counts.toPandas())


def predictor(spark: SparkSession, model: ContextTrees):
    """A function from a text column to a struct of lang_pred, score and bits_per_byte."""
    shared = spark.sparkContext.broadcast(model)  # at most TABLE_LIMIT

    @pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts.tolist())

    return predict


def identify(docs: DataFrame, model: ContextTrees, text_col: str = "text") -> Column:
    """The prediction for a column of docs, as a struct."""
    return predictor(docs.sparkSession, model)(F.col(text_col).cast("string"))


def training_rows(docs: DataFrame, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id") -> tuple[DataFrame, Column]:
    """id, text and lang of the rows to learn from, and the condition of those held out: crc32 of the id as text, by modulus."""
    held = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == held_out
    held = F.coalesce(held, F.lit(False))
    return docs.filter(~held).select(F.col(id_col).alias("id"), "text", "lang"), held
