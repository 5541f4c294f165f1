"""Packing documents into sequences: best fit, then swap-based local search.

Every document is encoded, ended, and cut only where it is longer than a sequence. Full pieces are
sequences of their own. The rest is dealt by hash into groups of about GROUP pieces, each packed by
best fit from the longest piece down; then, while a bin may go, pieces of the emptiest bin move to
others or are exchanged one for one, one for two or two for one, each step raising the sum of squared
fills. The search ends at a lower bound or where no pair of bins has a step. The pieces of bins that stay
open are dealt anew, into groups of the same size, and packed again, until one group held them all or a round
saves less than GAIN of its bins: no task ever holds more than a group.

Defined cases: ids are whole numbers of 64 bits, or missing; a null text is empty, its piece is the end id; an empty table gives no row; equal rows
are packed each for itself, and dealt apart; a text of any length is cut into whole sequences and a rest;
extra columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.tokenizing import default_path, encoder
from plenum.storage import cut

#: Pieces that one task packs, about.
GROUP = 1024
#: A bin with less room than this share of its size is closed; a round that saves less than this share of its bins is the last.
CLOSED, GAIN = 0.005, 0.001

#: A missing id is 0 with no_id, as pandas has no longs with gaps.
PIECE = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "no_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, size: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, in order."""
    tokenizer = tokenizer or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            out = []
            for k, none, text in zip(batch["k"], batch["z"], batch["t"], strict=True):
                ids = enc.ids(text) + end
                for p, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    out.append((k, none, p, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(out, columns=NAMES)

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k"), F.col(id_col).isNull().alias("z"), F.col(text_col).cast("string").alias("t")).mapInPandas(cut_up, PIECE)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of indices: each piece, from the longest down, goes to the bin that it leaves the least room in."""
    room: dict[int, list[int]] = {}
    mask, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = size, len(bins)
            bins.append([i])
        left = r - n
        if left:
            room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def least_bins(lengths: np.ndarray, size: int) -> int:
    """A lower bound: pieces over half a bin share none; what is not longer than k finds no place beside those over size - k."""
    n = np.sort(lengths)
    if not len(n):
        return 0
    total = np.concatenate([[0], np.cumsum(n)])
    half = int(np.searchsorted(n, size // 2, "right"))
    at = np.unique(np.searchsorted(n, n[:half]))  # the first piece of each length up to the half
    beside = np.searchsorted(n, size - n[at], "right")  # pieces over size - k come from here
    large, middle = len(n) - half, beside - half
    over = (total[half] - total[at]) - (middle * size - (total[beside] - total[half]))
    return max(-(-int(total[-1]) // size), large + int(np.maximum(0, -(-over // size)).max(initial=0)))


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Fewer bins, if pieces of the emptiest can move out; every step raises the sum of squared fills.

    A move of n to a bin at least as full as what its own keeps, or an exchange that makes the fuller of
    two bins fuller, raises it; so the search ends. It ends at the lower bound or where no pair of bins
    has a step: a bin meets all others, and later only those that have changed. Of those it meets, the bins
    whose room and extreme pieces rule a step out are passed over at once.
    """
    n_of = lengths.tolist()
    sizes = [sorted((n_of[i], i) for i in b) for b in bins]
    fill = np.array([sum(n for n, _ in b) for b in sizes], np.int64)
    #: Least, longest, and sum of the two least pieces of each bin.
    ends = np.zeros((len(bins), 3), np.int64)

    def note(k: int) -> None:
        own = sizes[k]
        if own:
            ends[k] = own[0][0], own[-1][0], own[0][0] + own[1][0] if len(own) > 1 else 2 * size

    for k in range(len(bins)):
        note(k)
    need = least_bins(lengths, size)
    alive = np.array([bool(b) for b in sizes])
    left = int(alive.sum())
    log: list[int] = []  # bins in the order of their changes
    met, changed = [-1] * len(bins), [0] * len(bins)  # length of the log when a bin had met the others, and when it changed
    queue = sorted((int(fill[k]), k) for k in np.flatnonzero(alive))
    while left > need and queue:
        _, source = heappop(queue)
        others = np.flatnonzero(alive & (fill < size)) if met[source] < changed[source] else np.unique(np.array(log[met[source] :], np.int64))
        others = others[alive[others] & (others != source) & (fill[others] < size)]
        others = others[np.lexsort((others, -fill[others]))]
        moved, before = True, len(log)
        while moved and sizes[source]:
            moved = False
            for k in others[_may_step(sizes[source], ends[others], size - fill[others])].tolist():
                gap = size - int(fill[k])
                if gap and fill[k] >= fill[source] > 0 and (step := _step(sizes[source], sizes[k], gap)):
                    out, back = step
                    sizes[source] = sorted([x for x in sizes[source] if x not in out] + back)
                    sizes[k] = sorted([x for x in sizes[k] if x not in back] + out)
                    shift = sum(n for n, _ in out) - sum(n for n, _ in back)
                    fill[source] -= shift
                    fill[k] += shift
                    note(source)
                    note(k)
                    log += [source, k]
                    changed[source] = changed[k] = len(log)
                    moved = True
        if not sizes[source]:
            alive[source] = False
            left -= 1
        if len(log) > before:  # what changed may help the others, and the source again
            queue = sorted((int(fill[k]), k) for k in np.flatnonzero(alive))
        else:
            met[source] = len(log)
    return [[i for _, i in sizes[k]] for k in np.flatnonzero(alive)]


def _may_step(own: list[tuple[int, int]], ends: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Bins that a step is not ruled out for, by the least and the longest pieces of the two."""
    least, longest, two = ends.T
    a, z = own[0][0], own[-1][0]
    may = (a <= gap) | ((z > least) & (a - longest <= gap)) | (z > two)
    if len(own) > 1:
        may |= (z + own[-2][0] > least) & (a + own[1][0] - longest <= gap)
    return may


def _step(own: list[tuple[int, int]], other: list[tuple[int, int]], gap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
    """What goes out of own and what comes back so that other gains at most gap: the best of moves and exchanges one for one, else of those with two on a side; null if there are none. Pieces are (length, index), by length."""
    at = bisect_right(own, (gap, len(own) + (1 << 62)))
    if at:  # the longest that fits
        best, step = own[at - 1][0], ([own[at - 1]], [])
    else:
        best, step = 0, None
    theirs = [n for n, _ in other]
    for x in own[at:]:
        k = bisect_left(theirs, x[0] - gap)  # the least that must come back
        if k < len(theirs) and best < x[0] - theirs[k]:
            best, step = x[0] - theirs[k], ([x], [other[k]])
        if best == gap:
            return step
    if step:
        return step
    for a, x in enumerate(own):
        for y in own[a + 1 :]:
            n = x[0] + y[0]
            k = bisect_left(theirs, n - gap)
            if k < len(theirs) and best < n - theirs[k]:
                best, step = n - theirs[k], ([x, y], [other[k]])
        for b, n in enumerate(theirs):
            k = bisect_left(theirs, x[0] - gap - n, b + 1)
            if k < len(theirs) and best < x[0] - n - theirs[k]:
                best, step = x[0] - n - theirs[k], ([x], [other[b], other[k]])
        if best == gap:
            return step
    return step


def _packer(size: int):
    """Packs one group; full enough bins are closed."""

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "u"], ascending=[False, True], ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins = local_search(best_fit(lengths, size), lengths, size)
        which, place, fill = np.zeros(len(frame), "int64"), np.zeros(len(frame), "int64"), np.zeros(len(bins), "int64")
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                which[i], place[i] = b, at
                at += int(lengths[i])
            fill[b] = at
        frame["bin"], frame["offset"], frame["closed"] = which, place, fill[which] >= size * (1 - CLOSED)
        return frame[[*NAMES, "u", "g", "bin", "offset", "closed"]]

    return packed


def pack(rows: DataFrame, size: int = 4096) -> DataFrame:
    """rows (of pieces) with sequence_id and offset."""
    rows = cut(rows).withColumn("u", F.monotonically_increasing_id())  # over rows that are written: the same whenever they are read
    done = [rows.filter(F.col("length") >= size).select(*NAMES, F.lit(0).cast("long").alias("round"), F.col("u").alias("bin"), F.lit(0).cast("long").alias("offset"))]
    open_rows = rows.filter(F.col("length") < size)
    left, bins, number = open_rows.count(), None, 0
    schema = PIECE + ", u long, g int, bin long, offset long, closed boolean"
    while left:
        number += 1
        groups = -(-left // GROUP)
        dealt = open_rows.select(*NAMES, "u", F.pmod(F.xxhash64("u", F.lit(number)), F.lit(groups)).cast("int").alias("g"))
        out = cut(dealt.groupBy("g").applyInPandas(_packer(size), schema))
        # A bin's first piece stands for it.
        now, still, left = out.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & ~F.col("closed")), F.count_if(~F.col("closed"))).first()
        last = groups == 1 or (bins is not None and now > bins * (1 - GAIN))
        done.append((out if last else out.filter("closed")).select(*NAMES, F.lit(number).cast("long").alias("round"), ((F.col("g").cast("long") * (1 << 24)) + F.col("bin")).alias("bin"), "offset"))
        if last:
            break
        open_rows, bins = out.filter("not closed"), still
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", (F.col("round") * (1 << 57) + F.col("bin")).alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, size: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack(pieces(docs, size, tokenizer, end_id, id_col, text_col), size)
