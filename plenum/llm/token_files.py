"""Token files: concatenated ids with Elias-Fano encoded document boundaries.

A file set is a Parquet table of blocks in ascending document order. A block holds whole documents:
their ids end to end (16 bits each where all fit, else 32), the document boundaries and the document
ids as Elias-Fano sequences with their select directories, and its first document's offset within its
part. Readers get a document's place from select on the boundaries alone: no table of offsets is kept.

Defined cases: ids are whole numbers of 64 bits, or missing; a null text is empty and has the end id alone; empty tables give no block; documents
without an id come first, in blocks of their own kind; equal ids are all kept, by the hash of their texts;
equal rows may fall to several parts; a text of any length is one document, never divided; extra columns
play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.tokenizing import default_path, encoder
from plenum.storage import partitions

#: Ids after which a block is closed; a document is never divided.
BLOCK_IDS = 1 << 19
#: Set bits between two entries of a select directory.
EVERY = 256

BLOCK = "part int, base long, n_docs int, n_ids long, width int, ids binary, bounds binary, doc_ids binary"
DOCUMENT = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of n integers in 0..u: low bits packed, high parts as unary gaps, and where every EVERY-th gap ends."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, base: int, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.base, self.directory = n, low_bits, low, high, base, directory

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        base = int(v[0]) if n else 0
        shifted = v.astype(np.uint64) - np.uint64(base % 2**64)  # wraps as it should
        u = int(shifted[-1]) if n else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        k = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((shifted[:, None] >> k) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (shifted >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), base, ones[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits, self.base, len(self.low)], "<i8").tobytes() + self.directory.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> EliasFano:
        n, low_bits, base, m = (int(x) for x in np.frombuffer(b, "<i8", 4))
        entries = -(-n // EVERY)
        at = 32 + 4 * entries
        return cls(n, low_bits, np.frombuffer(b, np.uint8, m, at), np.frombuffer(b, np.uint8, offset=at + m), base, np.frombuffer(b, "<u4", entries, 32))

    def select(self, at) -> np.ndarray:
        """The values at the places at (ascending): each directory entry leads to its stretch of the unary gaps, which alone is unpacked."""
        at = np.asarray(at, np.int64)
        if len(at) and not 0 <= at[0] <= at[-1] < self.n:
            raise IndexError(at)
        ones = np.empty(len(at), np.int64)
        cell = at // EVERY
        for c in np.unique(cell).tolist():
            first = int(self.directory[c]) >> 3
            last = (int(self.directory[c + 1]) >> 3) + 1 if c + 1 < len(self.directory) else len(self.high)
            set_bits = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
            set_bits = set_bits[np.searchsorted(set_bits, self.directory[c]) :]
            lo, hi = np.searchsorted(cell, [c, c + 1])
            ones[lo:hi] = set_bits[at[lo:hi] - c * EVERY]
        high = (ones - at).astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits):
            bit = at * self.low_bits + k
            high |= (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(k)
        return (high + np.uint64(self.base % 2**64)).astype(np.int64)


def _block(part: int, base: int, docs: list, parts: list[bytes]) -> dict:
    ids = np.frombuffer(b"".join(parts), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    bounds = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
    named = docs[0] is not None
    return {
        "part": part, "base": base, "n_docs": len(docs), "n_ids": len(ids), "width": width, "ids": ids.astype(f"<u{width}").tobytes(),
        "bounds": EliasFano.of(bounds).to_bytes(), "doc_ids": EliasFano.of(docs).to_bytes() if named else None,
    }


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the blocks to path, in ascending order of id_col."""
    tokenizer = tokenizer or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, parts, base, size = [], [], 0, 0
        for batch in batches:
            for k, none, text in zip(batch["k"].tolist(), batch["z"], batch["t"], strict=True):
                k = None if none else k
                if parts and (size >= BLOCK_IDS or (k is None) != (ids[0] is None)):
                    yield pd.DataFrame([_block(part, base, ids, parts)])
                    ids, parts, base, size = [], [], base + size, 0
                ids.append(k)
                parts.append(enc.ids(text) + end)
                size += len(parts[-1]) // 4
        if parts:
            yield pd.DataFrame([_block(part, base, ids, parts)])

    # A missing id is the least number with a flag: pandas has no longs with gaps. Equal ids are parted by the hash
    # of their texts, and equal rows by their place in the input, so that no key has to go to one task.
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(id_col).isNull().alias("z"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("m"), text.alias("t"))
    order = [F.col("k"), F.desc("z"), F.col("h"), F.col("m")]
    rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("k", "z", "t").mapInPandas(blocks, BLOCK).write.mode("overwrite").parquet(path)


def place(bounds: EliasFano, i: int) -> tuple[int, int]:
    """Where the ids of a block's i-th document begin and end in it."""
    first, last = bounds.select([i, i + 1]).tolist()
    return first, last


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ids = np.frombuffer(b.ids, f"<u{b.width}").astype("<u4")
                bounds = EliasFano.from_bytes(b.bounds).select(np.arange(b.n_docs + 1))
                raw = memoryview(ids.tobytes())
                names = [None] * b.n_docs if b.doc_ids is None else EliasFano.from_bytes(b.doc_ids).select(np.arange(b.n_docs))
                yield pd.DataFrame({
                    "doc_id": pd.array(names, "Int64"), "part": b.part, "part_start": b.base + bounds[:-1], "n_tokens": np.diff(bounds),
                    "ids_crc32": [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)],
                })

    files = spark.read.parquet(path)
    # One row for each part that was written: the number of partitions bounds it.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    offsets, at = [], 0
    for r in totals:
        offsets.append((r["part"], at))
        at += r["n"]
    rows = files.mapInPandas(documents, DOCUMENT)
    if not offsets:
        return rows.select("doc_id", F.lit(0).cast("long").alias("start"), "n_tokens", "ids_crc32")
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, part_base long"))
    return rows.join(starts, "part").select("doc_id", (F.col("part_base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
