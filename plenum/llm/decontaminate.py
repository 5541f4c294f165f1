"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (ten words in a row; a shorter item is one window) must occur whole, so its
necessary prefix is a single token: the one that is rarest over all documents. Windows are joined with
document words on that token, the token's place in the window and the two lengths bound where the
window can lie, and the candidate is verified word for word.

The windows of one block of items are sent to every worker; a block holds about BLOCK_WORDS words at most, or one item.
A larger benchmark is dealt into blocks by hash and joined block by block: the driver holds one block at a time, and
each has a pass of its own that keeps what it found of the documents it hit. Before, the words of all items are
counted in the documents, BLOCK_WORDS distinct ones in a pass, and written.

Defined cases: a null text has no words; an item without an id or without a word is no item; items may
share windows or ids; ids may be of any type and are sorted as strings; an empty benchmark hits nothing; a row
is judged as often as it occurs; a text of any length is searched whole; an empty table gives no row;
extra columns stay, but for one of the name of the result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from plenum.storage import cut, free_names

WINDOW = 10
#: Words of the items that are sent to workers at once, and distinct ones that are counted at once.
BLOCK_WORDS = 500_000

#: Lower case for A-Z; a space for other ASCII characters that are no letters or digits.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

Index = dict[bytes, list[tuple[int, list[bytes], tuple[str, ...]]]]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def build_index(items: list[tuple[str, str]], frequency: dict[bytes, int], window: int = WINDOW) -> Index:
    """Rarest word to (its place, the window, the items that have it)."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            owners[tuple(words[at : at + window])].add(item)
    index: Index = defaultdict(list)
    for own, ids in owners.items():
        place = min(range(len(own)), key=lambda k: (frequency.get(own[k], 0), own[k], k))
        index[own[place]].append((place, list(own), tuple(sorted(ids))))
    return dict(index)


def find(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of words that windows cover, and the items they are of."""
    spans, items, n = [], set(), len(words)
    for at in [k for k, w in enumerate(words) if w in index]:
        for place, own, ids in index[words[at]]:
            first, last = at - place, at - place + len(own)
            if first >= 0 and last <= n and words[first:last] == own:
                spans.append((first, last))
                items.update(ids)
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged, items


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i and t of the items."""
    return benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))


def _vocabulary(items: DataFrame) -> DataFrame:
    """w: the distinct words of the items."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"w": sorted({w for t in batch["t"] for w in words_of(t)})}, columns=["w"])

    return items.select("t").mapInPandas(distinct, "w binary").distinct()


def word_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> DataFrame:
    """w and n: how often words of the vocabulary, of at most BLOCK_WORDS words, occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        wanted = shared.value.__contains__
        for batch in batches:
            for text in batch["t"]:
                found.update(filter(wanted, words_of(text)))
        yield pd.DataFrame({"w": list(found), "n": list(found.values())}, columns=["w", "n"]).astype({"n": "int64"})

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInPandas(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _frequency(counts: DataFrame) -> dict[bytes, int]:
    """The rows of a block's words."""
    return {bytes(r["w"]): r["n"] for r in counts.collect()}


def _indexes(docs: DataFrame, items: DataFrame, text_col: str, window: int) -> tuple[int, Iterator[Index]]:
    """The number of blocks, and the index of each."""
    size = items.agg(F.coalesce(F.sum(_counter()(F.col("t"))), F.lit(0))).first()[0]
    collected = lambda rows: [(r["i"], r["t"]) for r in rows.collect()]  # noqa: E731  the items of a block
    if size <= BLOCK_WORDS:
        own = collected(items)
        vocabulary = {w for _, t in own for w in words_of(t)}
        return 1, iter([build_index(own, _frequency(word_counts(docs, vocabulary, text_col)) if vocabulary else {}, window)])
    blocks = -(-2 * size // BLOCK_WORDS)  # half full, so that few are over
    dealt = cut(items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")))
    words = cut(_vocabulary(dealt))
    passes = -(-words.count() // BLOCK_WORDS)
    counts = None
    for k in range(passes):
        some = words.filter(F.pmod(F.xxhash64("w"), F.lit(passes)) == k)
        own = cut(word_counts(docs, {bytes(r["w"]) for r in some.collect()}, text_col))
        counts = own if counts is None else counts.unionByName(own)

    def each() -> Iterator[Index]:
        for k in range(blocks):
            block = dealt.filter(F.col("b") == k)
            yield build_index(collected(block), _frequency(counts.join(_vocabulary(block), "w")), window)

    return blocks, each()


def contamination(docs: DataFrame, benchmark: DataFrame, result: str = "contamination", window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with a struct: n_words, n_hit, n_items, items_sha256, contaminated, spans and items."""
    sc = docs.sparkSession.sparkContext
    blocks, indexes = _indexes(docs, _items(benchmark, item_id, item_text), text_col, window)
    if blocks == 1:
        index = sc.broadcast(next(indexes))
        return docs.withColumn(result, _folded(F.array(_finder(index)(F.col(text_col).cast("string")))))
    # Equal texts have equal findings: those of the texts that are hit are kept by two hashes of the text.
    one, two, found, n = free_names(docs, "one", "two", "found", "n")
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn(one, F.xxhash64(text)).withColumn(two, F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    hits = None
    for index in indexes:
        if not index:
            continue
        shared = sc.broadcast(index)
        own = cut(keyed.select(one, two, _finder(shared)(text).alias(found)).filter(F.size(f"{found}.items") > 0).dropDuplicates([one, two]))
        shared.unpersist()
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.groupBy(one, two).agg(F.collect_list(found).alias(found))  # one for each block at most
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast(f"array<{SPAN}>").alias("spans"), F.array().cast("array<string>").alias("items"))
    joined = keyed.withColumn(n, _counter()(text)).join(hits, [one, two], "left").withColumn(found, F.coalesce(found, F.array(none)))
    return joined.withColumn(result, _folded(F.col(found)).withField("n_words", F.col(n))).select(*[c for c in docs.columns if c != result], result)


SPAN = "struct<first: long, last: long>"


def _counter():
    @pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    return count


def _finder(index):
    @pandas_udf(f"n_words long, spans array<{SPAN}>, items array<string>")
    def hits(texts: pd.Series) -> pd.DataFrame:
        n, spans, items = [], [], []
        for text in texts:
            words = words_of(text)
            own, ids = find(words, index.value)
            n.append(len(words))
            spans.append([{"first": a, "last": b} for a, b in own])
            items.append(sorted(ids))
        return pd.DataFrame({"n_words": n, "spans": spans, "items": items})

    return hits


def _folded(blocks: Column) -> Column:
    """The blocks' findings as one: spans are united, items counted once."""

    def fold(of: Column) -> Column:
        spans = F.array_sort(F.flatten(F.transform(of, lambda b: b["spans"])))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(acc["end"], s["first"]))).alias("n"), F.greatest(acc["end"], s["last"]).alias("end"))
        hit = F.aggregate(spans, zero, step)["n"]
        items = F.array_sort(F.array_distinct(F.flatten(F.transform(of, lambda b: b["items"]))))
        return F.struct(
            F.element_at(of, 1)["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), spans.alias("spans"), items.alias("items"),
        )

    return F.element_at(F.transform(F.array(blocks), fold), 1)  # the lambda binds the findings, so that they are made once
