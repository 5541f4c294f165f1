"""Divergence of the sources of a language, over a vocabulary told apart by bytes.

Texts are read as the UTF-8 octets of an Arrow column. A table of 256 entries lower-cases A-Z and puts zero for
octets that are part of no term; where its result goes from zero, or from another text, to something, a term
starts. Each term's octets are hashed with XXH64, the hashes group them, and each member of a group is held against its
first octet by octet: of a group with more than one spelling, the members are told apart by their octets. What is left
of a stretch of texts is one row for each (language, source, term), which Spark sums.

The terms that enough documents of a language have are dealt into blocks. A block is a sparse matrix in rows of sources; a pair's
sum of differences is that of the shares of terms that neither has, moved by the entries of each row, which reduceat
sums. All arithmetic is on whole numbers. Blocks of pairs' sums are summed by Spark, and each block names the terms of a source
that can be among its first; windows of a group's bounded candidates rank them.

Defined cases: null languages, sources and texts are empty strings; a text without terms, of any length, belongs to its group; groups
without terms and languages without a vocabulary have their pairs, at zero; equal rows are documents each; repeated and missing ids do
not matter, as no id is read; ties go by the octets of the item; an empty table gives no row; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.storage import cut

#: Documents of a language that a term of its vocabulary is in, and ranks of a group's terms.
LEAST_DOCS, RANKS = 30, 50
SCALE, PRIOR = 10**9, 5
#: Octets of texts that are told apart at once (a longer text is one stretch), and rows of counts in a block.
STRETCH, BLOCK = 4 << 20, 20_000
#: Sources whose pairs with all others are a task's.
PART = 256

LOWER = np.zeros(256, np.uint8)
for _first, _last in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    LOWER[_first : _last + 1] = np.arange(_first, _last + 1)
LOWER[0x41:0x5B] += 32


def slices(raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The octets after LOWER, and where terms start and end. texts: where each text starts in raw."""
    low = LOWER[raw]
    of = low != 0
    joint = np.zeros(len(low) + 1, bool)  # between an octet and the next: both of one term
    joint[1:-1] = of[1:] & of[:-1]
    joint[texts] = False
    return low, np.flatnonzero(of & ~joint[:-1]), np.flatnonzero(of & ~joint[1:]) + 1


def spellings(low: np.ndarray, start: np.ndarray, end: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's spelling, and a slice of each spelling: grouped by hash, verified by octets."""
    octets = memoryview(low.tobytes())
    hashes = np.fromiter((digest(octets[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    length, model = end - start, first[group]
    odd = length != length[model]
    at = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(at[-1], dtype=np.int64) - np.repeat(at[:-1], length)
    same = low[np.repeat(start, length) + place] == low[np.minimum(np.repeat(start[model], length) + place, len(low) - 1)]
    odd |= np.logical_or.reduceat(~same, at[:-1])
    if odd.any():  # another spelling under the same hash: numbered by its octets
        known: dict[bytes, int] = {}
        more = []
        for k in np.flatnonzero(odd).tolist():
            word = bytes(octets[start[k] : end[k]])
            if word not in known:
                known[word] = len(first) + len(more)
                more.append(k)
            group[k] = known[word]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return group, first


def stretch_counts(raw: np.ndarray, texts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of each group and term of it: the group, the term, its occurrences and its texts. groups: the number of each text's group."""
    low, start, end = slices(raw, texts)
    if not len(start):
        return np.empty(0, np.int64), [], np.empty(0, np.int64), np.empty(0, np.int64)
    term, first = spellings(low, start, end)
    text = np.searchsorted(texts, start, "right") - 1
    cells, n = np.unique(term * len(texts) + text, return_counts=True)  # a sparse matrix of terms by texts
    term, group = cells // len(texts), groups[cells % len(texts)]
    order = np.lexsort((group, term))
    term, group, n = term[order], group[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])]))
    octets = low.tobytes()
    names = [octets[start[k] : end[k]].decode("utf-8", "replace") for k in first[term[edge]].tolist()]
    return group[edge], names, np.add.reduceat(n, edge), np.diff(np.append(edge, len(term)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, source, text = (batch.column(k) for k in range(3))
        lang, source = lang.dictionary_encode(), source.dictionary_encode()
        kinds, kind = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        langs, sources = lang.dictionary.take(pa.array(kinds // len(source.dictionary))), source.dictionary.take(pa.array(kinds % len(source.dictionary)))
        width = np.int64 if pa.types.is_large_string(text.type) else np.int32
        offsets = np.frombuffer(text.buffers()[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        octets = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STRETCH, "right")) - 1)
            group, names, n, docs = stretch_counts(octets[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo], kind[lo:hi])
            at = pa.array(group)
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), pa.array(names, pa.string()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])
            lo = hi


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (its occurrences there) and docs (the documents there that have it)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact for counts up to 9e15: the quotient three decimal digits at a time."""
    below = np.asarray(total, np.int64) + PRIOR * terms
    quotient, rest = np.divmod(np.asarray(n, np.int64) + PRIOR, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        quotient = quotient * 1000 + more
    return 1 + quotient


def pair_sums(row: np.ndarray, term: np.ndarray, p: np.ndarray, none: np.ndarray, terms: int, rows: range) -> Iterator[tuple[int, np.ndarray]]:
    """For each source of rows, its sums of differences with those after it. A sparse matrix, sorted by row and term:
    p of the entries, none: of each source, what it has where it has no entry."""
    starts = np.searchsorted(row, np.arange(len(none) + 1))
    filled = np.flatnonzero(np.diff(starts))  # reduceat has no empty segments
    for a in rows:
        if a + 1 == len(none):
            break
        own, q = term[starts[a] : starts[a + 1]], p[starts[a] : starts[a + 1]]
        dense = np.full(terms, none[a])
        dense[own] = q
        # As if no other source had an entry: the terms that a has not, then those it has, by their order.
        ordered = np.sort(q)
        sums, k = np.concatenate([[0], np.cumsum(ordered)]), np.searchsorted(ordered, none)
        total = (terms - len(q)) * np.abs(none - none[a]) + none * (2 * k - len(q)) + sums[-1] - 2 * sums[k]
        if len(filled):  # then what the entries of each move
            here = dense[term]
            total[filled] += np.add.reduceat(np.abs(here - p) - np.abs(here - none[row]), starts[filled])
        yield a, total[a + 1 :]


def _block(part: int, ranks: int):
    columns = ["lang", "part", "a", "b", "value"]

    def compare(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("source", key=lambda c: c.str.encode("utf-8"), ignore_index=True)
        names, total, terms = groups["source"].to_numpy(object), groups["total"].to_numpy(np.int64), int(groups["terms"].iloc[0])
        lang, at = groups["lang"].iloc[0], int(groups["part"].iloc[0])
        none = shares(np.zeros(len(names), np.int64), total, terms) if terms else np.zeros(len(names), np.int64)
        words, term = np.unique(counts["term"].to_numpy(object).astype(object), return_inverse=True)
        where = {s: k for k, s in enumerate(names)}
        row = np.array([where[s] for s in counts["source"]], np.int64)
        order = np.lexsort((term, row))
        row, term, n, all_n = row[order], term[order], counts["n"].to_numpy(np.int64)[order], counts["lang_n"].to_numpy(np.int64)[order]
        p = shares(n, total[row], terms) if len(row) else np.empty(0, np.int64)
        out = []
        mine = range(at * part, min(len(names), (at + 1) * part))
        for a, sums in pair_sums(row, term, p, none, len(words), mine):
            out.append(pd.DataFrame({"lang": lang, "part": "pair", "a": names[a], "b": names[a + 1 :], "value": sums}))
        excess = p - shares(all_n, int(total.sum()), terms) if len(row) else p
        for a in mine:
            lo, hi = np.searchsorted(row, [a, a + 1])
            f, t = excess[lo:hi], term[lo:hi]
            best = np.lexsort((t, -f))[:ranks]
            best = best[f[best] > 0]
            if len(best):
                out.append(pd.DataFrame({"lang": lang, "part": "term", "a": names[a], "b": words[t[best]], "value": f[best]}))
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return compare


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block: int = BLOCK, part: int = PART) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the others by their divergence from it (part pair), and the terms it has more of than
    its language (part term, ranks of them)."""
    same_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col).withColumn("all_docs", F.sum("docs").over(same_term)).withColumn("lang_n", F.sum("n").over(same_term))
    first = F.row_number().over(same_term.orderBy("source")) == 1
    kept = cut(counts.withColumn("first", first.cast("int")).filter(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"))

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)]
    groups = docs.select(text[0].alias("lang"), text[1].alias("source")).groupBy("lang", "source").agg(F.lit(1).alias("one")).select("lang", "source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"), F.count("*").alias("cells"))
    groups = groups.join(totals, ["lang", "source"], "left").na.fill(0)
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumn("terms", F.sum("firsts").over(of_lang)).withColumn("cells", F.sum("cells").over(of_lang)).withColumn("sources", F.count("*").over(of_lang))
    # A block's sums are a row for each pair, so blocks have at least as many cells.
    per_block = F.greatest(F.lit(block), F.col("sources") * F.col("sources"))
    groups = cut(groups.select("lang", "source", "total", "terms", F.ceil(F.col("cells") / per_block).cast("int").alias("blocks"), F.ceil(F.col("sources") / part).cast("int").alias("parts")).withColumn("blocks", F.greatest("blocks", F.lit(1))))

    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    spread = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("lang", "block", parts, "source", "total", "terms")
    langs = groups.select("lang", "blocks", "parts").distinct()
    cells = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).select("lang", "block", parts, "source", "term", "n", "lang_n")
    keys = ["lang", "block", "part"]
    compared = cells.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_block(part, ranks), "lang string, part string, a string, b string, value long")
    summed = compared.groupBy("lang", "part", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.when(F.col("part") == "pair", F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).otherwise(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"))))
    rows = summed.select("lang", "part", "value", F.explode(ways).alias("w")).select("lang", "w.source", "part", "w.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return rows.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
