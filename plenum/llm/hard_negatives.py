"""Hard negatives by distributed radix selection over integer scores.

Vectors become whole numbers, a score is an integer inner product. Anchors come in waves of bounded size, each broadcast
once; a pass takes every row against the wave, in blocks of a matrix product. A window is an anchor, a side (rows of its
label or of others) and a range of scores; its K first rows are found by digits. Each task counts the rows of a window by the
first digit of their place in the range, and sends only the first buckets that hold K of its own, as the K-th row of all
cannot lie behind them. Spark sums the buckets and names the one with the K-th row; it is parted by the next digit,
until it is a score. Rows that tie there are parted by the digits of their ids, and rows of one id by their place, so
a group of equal vectors of any size is counted and never gathered. When few rows are left in a window a
last pass gathers them, and only them, and a sort of these ranks them.

First the windows are the anchors, for their positives, then each anchor with each of its positives. Scores are exact:
the product is in single or double precision where every partial sum fits its mantissa, else in 64-bit integers; vectors whose
scores, in per cent, might not fit 64 bits are refused.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; rows without an id are
no anchors, and come after all ids in ties; repeated ids are rows of their own, told apart by their place; vectors meet only those of
their length, empty ones included, at score zero; a window with fewer rows gives all it has; a table without anchors, or an empty one,
gives no row; texts play no part, and neither do columns other than the three named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.storage import cut, partitions

POSITIVES, NEGATIVES = 5, 5
#: Per cent of the positive's score that a negative has.
BAND = (80, 100)
SCALE = 256
#: Numbers in the vectors of a wave's anchors, and anchors of a block of the product.
WAVE, ANCHORS = 2_000_000, 256
#: Bits of a digit, and rows of a window that are gathered without another digit.
DIGIT, GATHER = 12, 32
NO_ID = np.iinfo(np.int64).max
#: What a window's range is over: scores (negated, so that small comes first), then ids, then rows.
SCORE, ID, ROW = 0, 1, 2


def prepared(rows: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """row, id, label, dim, vec (whole numbers) and anchor of the rows that take part, written once."""
    vec = F.col(vector_col).cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vec, lambda x: F.floor(x * scale))
    own = rows.filter(F.col(label_col).isNotNull() & vec.isNotNull() & sound)
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return cut(own.repartition(partitions(rows.sparkSession)).select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("vec").alias("dim"), "vec", (F.col("anchor") & F.col("id").isNotNull()).alias("anchor")))


@dataclass
class Wave:
    """Anchors, as arrays."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vec: np.ndarray  # of the type in which products are exact


@dataclass
class Windows:
    """Arrays with an entry a window: its anchor, its first and last place in the range that is open, what is fixed before it, and the rows still to find."""

    anchor: np.ndarray
    same: bool
    first: np.ndarray  # of the range of scores at the start
    lo: np.ndarray
    hi: np.ndarray
    stage: np.ndarray
    score: np.ndarray
    id: np.ndarray
    need: np.ndarray
    shift: np.ndarray

    @classmethod
    def start(cls, anchor: np.ndarray, same: bool, lo: np.ndarray, hi: np.ndarray, k: int) -> Windows:
        none = np.zeros(len(anchor), np.int64)
        return cls(anchor, same, lo.copy(), lo.copy(), hi.copy(), none.copy(), none.copy(), none.copy(), none + k, none.copy())

    def members(self, w: int, u: np.ndarray, ids: np.ndarray, rows: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of a window's open range are, and their places in it."""
        if self.stage[w] == SCORE:
            key = u
        else:
            valid = valid & (u == self.score[w])
            key = ids
            if self.stage[w] == ROW:
                valid, key = valid & (ids == self.id[w]), rows
        at = np.flatnonzero(valid & (key >= self.lo[w]) & (key <= self.hi[w]))
        return at, key[at]

    def ahead(self, w: int, u: np.ndarray, ids: np.ndarray, rows: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Where the rows of a window are that are not behind its range's last place."""
        key = (u, ids, rows)[self.stage[w]]
        good = key <= self.hi[w]
        if self.stage[w] == ROW:
            good = (ids < self.id[w]) | ((ids == self.id[w]) & good)
        if self.stage[w] != SCORE:
            good = (u < self.score[w]) | ((u == self.score[w]) & good)
        return np.flatnonzero(valid & (u >= self.first[w]) & good)


def _scores(batches: Iterator[pa.RecordBatch], wave: Wave, windows: Windows, which: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the windows and batch of rows: the window, the rows' negated scores, ids and numbers, and which are of its side."""
    order = which[np.argsort(windows.anchor[which], kind="stable")]
    starts = np.searchsorted(windows.anchor[order], np.arange(len(wave.row) + 1))
    used = np.flatnonzero(np.diff(starts))
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        ids = batch.column(1).fill_null(NO_ID).to_numpy()
        vec = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, wave.vec.shape[1]).astype(wave.vec.dtype)
        for lo in range(0, len(used), ANCHORS):
            block = used[lo : lo + ANCHORS]
            scores = -(wave.vec[block] @ vec.T).astype(np.int64)
            for u, a in zip(scores, block, strict=True):
                valid = (labels == wave.label[a]) & (rows != wave.row[a]) if windows.same else labels != wave.label[a]
                for w in order[starts[a] : starts[a + 1]]:
                    yield w, u, ids, rows, valid


def _histograms(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, windows = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, u, ids, rows, valid in _scores(batches, wave, windows, np.flatnonzero(windows.need)):
            _, key = windows.members(w, u, ids, rows, valid)
            digit = (key - windows.lo[w]).view(np.uint64) >> windows.shift[w].astype(np.uint64)
            k = int(windows.need[w])
            if w in held and held[w][1].sum() >= k:
                digit = digit[digit <= held[w][0][-1]]
            if len(digit) > k:
                digit = digit[digit <= np.partition(digit, k - 1)[k - 1]]
            if not len(digit):
                continue
            digits, n = np.unique(digit, return_counts=True)
            if w in held:
                digits, at = np.unique(np.concatenate([held[w][0], digits]), return_inverse=True)
                n = np.bincount(at, np.concatenate([held[w][1], n])).astype(np.int64)
            last = int(np.searchsorted(np.cumsum(n), k)) + 1  # the buckets up to the one with this task's K-th row
            held[w] = digits[:last], n[:last]
        if held:
            sizes = [len(d) for d, _ in held.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(list(held), np.int64), sizes)), pa.array(np.concatenate([d for d, _ in held.values()]).astype(np.int64)), pa.array(np.concatenate([n for _, n in held.values()]).astype(np.int64))],
                names=["w", "digit", "n"],
            )

    return count


def _gathered(shared):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, windows = shared.value
        for w, u, ids, rows, valid in _scores(batches, wave, windows, np.arange(len(windows.need))):
            at = windows.ahead(w, u, ids, rows, valid)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w, np.int64)), pa.array(-u[at]), pa.array(ids[at]), pa.array(rows[at])], names=["w", "score", "id", "row"])

    return gather


def _narrow(rows: DataFrame, wave: Wave, windows: Windows, ids: tuple[int, int], most_row: int) -> None:
    """Narrows every window's range to its first rows, need of them, and at most GATHER more that tie with the last."""
    spark, found = rows.sparkSession, np.zeros(len(windows.anchor), np.int64)
    windows.need[windows.lo > windows.hi] = 0
    need = windows.need.copy()  # of windows that are done, 0 from here on
    while windows.need.any():
        windows.shift = np.array([max(0, (int(b) - int(a)).bit_length() - DIGIT) for a, b in zip(windows.lo, windows.hi, strict=True)], np.int64)
        shared = spark.sparkContext.broadcast((wave, windows))
        counts = rows.mapInArrow(_histograms(shared), "w long, digit long, n long").groupBy("w", "digit").agg(F.sum("n").alias("n"))
        needs = {int(w): int(windows.need[w]) for w in np.flatnonzero(windows.need)}
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("w").orderBy("digit")))
        needed = F.broadcast(spark.createDataFrame(list(needs.items()), "w long, need long"))
        kth = {r["w"]: r for r in upto.join(needed, "w").filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).collect()}  # one row a window
        shared.destroy()
        for w in needs:
            if w not in kth:  # fewer rows than needed: all of the range
                windows.need[w] = 0
                continue
            r, shift = kth[w], int(windows.shift[w])
            before = r["upto"] - r["n"]
            found[w] += before
            windows.need[w] -= before
            windows.lo[w] = windows.lo[w] + (r["digit"] << shift)
            windows.hi[w] = min(int(windows.hi[w]), int(windows.lo[w]) + (1 << shift) - 1)
            if r["n"] + found[w] <= max(GATHER, int(need[w])):
                windows.need[w] = 0
            elif windows.lo[w] == windows.hi[w]:
                if windows.stage[w] == ROW:
                    windows.need[w] = 0
                elif windows.stage[w] == SCORE:
                    windows.stage[w], windows.score[w], windows.lo[w], windows.hi[w] = ID, windows.lo[w], *ids
                else:
                    windows.stage[w], windows.id[w], windows.lo[w], windows.hi[w] = ROW, windows.lo[w], 0, most_row


def select_first(rows: DataFrame, wave: Wave, windows: Windows, k: int, ids: tuple[int, int], most_row: int) -> DataFrame:
    """w, score, id, row and rank of the k first rows of every window, by score, id and place; written once."""
    _narrow(rows, wave, windows, ids, most_row)
    shared = rows.sparkSession.sparkContext.broadcast((wave, windows))
    gathered = rows.mapInArrow(_gathered(shared), "w long, score long, id long, row long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.col("score").desc(), "id", "row"))
    out = cut(gathered.withColumn("rank", rank).filter(F.col("rank") <= k))
    shared.destroy()
    return out


def _exact(dim: int, largest: int):
    """The number type in which a product of two vectors is exact."""
    bound = max(1, dim) * largest * largest
    if bound >= 1 << 56:  # its per cent fit 64 bits
        raise OverflowError(f"scores of {dim} components up to {largest}, in per cent, need more than 64 bits")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", wave_size: int = WAVE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first positives of the same label, the
    first rows of other labels whose score is within the band, in per cent of the positive's."""
    spark = rows.sparkSession
    base = prepared(rows, anchor, id_col, vector_col, label_col, scale)
    largest = F.max(F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x))), F.lit(0)))
    lengths = base.groupBy("dim").agg(largest.alias("largest"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.min("id").alias("first"), F.max("id").alias("last"), F.max("row").alias("row"), F.max(F.col("id").isNull()).alias("no_id")).collect()
    parts = []
    for n in lengths:  # one row a length of vectors
        if not n["anchors"]:
            continue
        kind, limit = _exact(n["dim"], n["largest"]), n["dim"] * n["largest"] ** 2
        ids = (n["first"], NO_ID if n["no_id"] else n["last"])
        own = base.filter(F.col("dim") == n["dim"])
        compared = own.select("row", "id", "label", "vec")
        waves = -(-n["anchors"] * max(1, n["dim"]) // wave_size)
        for k in range(waves):
            some = own.filter("anchor" if waves == 1 else F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(waves)) == k)).select("row", "id", "label", "vec").orderBy("row").collect()  # a wave: about wave_size numbers
            if some:
                parts.append(_mined(spark, compared, some, n["dim"], kind, limit, ids, n["row"], positives, negatives, band))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _mined(spark: SparkSession, rows: DataFrame, some: list, dim: int, kind, limit: int, ids: tuple[int, int], most_row: int, positives: int, negatives: int, band: tuple[int, int]) -> DataFrame:
    """The rows of one wave's anchors."""
    wave = Wave(np.array([r["row"] for r in some]), np.array([r["id"] for r in some]), np.array([r["label"] for r in some]), np.array([r["vec"] for r in some], dtype=kind).reshape(len(some), dim))
    every = np.arange(len(some))
    full = np.full(len(some), limit, np.int64)
    found = select_first(rows, wave, Windows.start(every, True, -full, full, positives), positives, ids, most_row).toPandas()  # a few rows for each anchor of the wave
    score = found["score"].to_numpy(np.int64)
    low, high = -(-band[0] * score // 100), band[1] * score // 100
    windows = Windows.start(found["w"].to_numpy(np.int64), False, -high, -low, negatives)
    named = spark.createDataFrame(pd.DataFrame({"w": np.arange(len(found)), "anchor_id": wave.id[windows.anchor], "positive": found["id"], "positive_score": score}), "w long, anchor_id long, positive long, positive_score long")
    mined = select_first(rows, wave, windows, negatives, ids, most_row)
    known = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    joined = mined.join(F.broadcast(named), "w")
    return joined.select("anchor_id", known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
