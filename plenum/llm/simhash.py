"""SimHash fingerprints, linked through pivot distance tables.

Each distinct fingerprint gets a table row: its Hamming distances to many reference fingerprints. The
references are zero, one for each PAIR of neighbouring bits, and PIVOTS random ones. By the triangle
inequality two fingerprints that differ in at most RADIUS bits differ by at most RADIUS in every coordinate.

The table alone makes the pairs. A random reference parts little (half of all distances to it lie within
RADIUS of each other), so the references of bit pairs do it: the distance to one, less the distance to zero,
moves only if one of its two bits differs. A difference of RADIUS bits moves at most RADIUS of these
coordinates, so of any B groups of them a linked pair agrees on at least B - RADIUS, and fingerprints meet
under the coordinates of each choice of that many groups: no link is lost. A pair that meets is discarded
by its largest coordinate difference over the random references, and what survives is verified on the bits.

A meeting place yields a spanning forest of its links, not its pairs. One that holds more than PLACE
fingerprints is dealt into parts and compared part by part, so no task takes it whole.

Defined cases: ids are whole numbers of 64 bits, or missing; null and empty texts have fingerprint zero, linked as any other; copies share one table
row; rows that repeat a doc_id repeat in the result; rows without an id are linked, but name no component
unless it has no id at all; a text of any length is hashed whole; extra columns play no part; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from plenum.operators.components import connected_components
from plenum.storage import cut, free_names, partitions

RADIUS = 3
#: Fingerprints up to which a meeting place has its links taken pair by pair.
FEW = 8
#: Random references, and references of two neighbouring bits.
PIVOTS, COORDINATES, PAIR = 16, 32, 3
#: Fingerprints of a meeting place that are compared in one task; two parts of half as many make a pair.
PLACE = 2048


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """64 bits, each set if over half the hashes of the word n-grams have it; A-Z count as a-z."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.array([digest(join(s), seed) for s in zip(*(words[k:] for k in range(n)))], "<u8")  # noqa: B905
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprint(n: int):
    @pandas_udf("long")
    def take(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, n) for t in texts], np.uint64).astype(np.int64))

    return take


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """doc_id and fp (the bits as a signed long) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _fingerprint(n)(F.col(text_col).cast("string")).alias("fp"))


def _keys(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """What tells a row from others: if it has no id, the id or 0, and the hash of its text."""
    return F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(F.col(text_col).cast("string"))


def references(count: int = PIVOTS) -> list[int]:
    """The random reference fingerprints, as signed longs: hashes of their numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % k)).astype(np.int64)) for k in range(count)]


def distance(reference: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(reference))).cast("long")


def pivot_table(fps: DataFrame, count: int = PIVOTS) -> DataFrame:
    """fps with their distances to the random references, eight to a long (t0, t1, ...), and in near the moves of
    the distances to the 32 references of bit pairs against that to zero, two bits each."""
    columns = []
    for at in range(0, count, 8):
        packed: Column = F.lit(0).cast("long")
        for k, r in enumerate(references(count)[at : at + 8]):
            packed = packed.bitwiseOR(F.shiftleft(distance(r), 8 * k))
        columns.append(packed.alias(f"t{at // 8}"))
    near: Column = F.lit(0).cast("long")
    for k in range(COORDINATES):
        pair = PAIR << 2 * k
        moved = F.shiftright(distance(0) + 2 - distance(pair - (1 << 64) if pair >> 63 else pair), 1)  # 0, 1 or 2
        near = near.bitwiseOR(F.shiftleft(moved, 2 * k))
    return fps.select("*", *columns, near.alias("near"))


def _groups(rows: int) -> int:
    """Groups of coordinates so that random fingerprints seldom meet: any number is exact."""
    return next((b for b, most in ((5, 10**6), (6, 2 * 10**7), (7, 2 * 10**8), (8, 10**9)) if rows <= most), 10)


def meeting_places(table: DataFrame, groups: int) -> DataFrame:
    """A row of table for each choice of groups: choice, and the coordinates of the groups in bits."""
    edges = [2 * (COORDINATES * k // groups) for k in range(groups + 1)]
    masks = []
    for chosen in combinations(range(groups), groups - RADIUS):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    places = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("near").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])
    kept = [c for c in table.columns if c != "near"]
    return table.select(*kept, F.explode(places).alias("p")).select(*kept, "p.choice", "p.bits")


def _forest(fp: np.ndarray, table: np.ndarray, side: np.ndarray, tally: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected in one meeting place. side: -1 if all pairs count, else 0 and 1 and pairs of the two.
    tally is raised by the pairs that meet, those that the table leaves, and those that the bits verify."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table, side = fp[order], table[order].astype(np.int16), side[order]
    root, bits = np.arange(len(fp)), fp.astype(np.uint64)
    ones = int(side.sum()) if side[0] >= 0 else 0
    tally[0] += ones * (len(fp) - ones) if side[0] >= 0 else len(fp) * (len(fp) - 1) // 2
    for lo in range(0, len(fp), 256):
        hi = min(len(fp), lo + 256)
        end = int(np.searchsorted(table[:, 0], table[hi - 1, 0] + RADIUS, "right"))
        i, j = np.nonzero(table[lo:hi, None, 0] >= table[None, lo:end, 0] - RADIUS)
        i, j = i + lo, j + lo
        keep = i < j
        if side[0] >= 0:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        for c in range(1, table.shape[1]):
            keep = np.abs(table[i, c] - table[j, c]) <= RADIUS
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(bits[i] ^ bits[j]) <= RADIUS
        tally[1:] += len(i), int(keep.sum())
        a, b = root[i[keep]], root[j[keep]]
        links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1) if len(a) else np.zeros((2, 0), int)
        for x, y in links.T.tolist():
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while not np.array_equal(up := root[root], root):
            root = up
    out = np.flatnonzero(root != np.arange(len(fp)))
    return list(zip(fp[out].tolist(), fp[root[out]].tolist(), strict=True))


def _few(fp: np.ndarray, table: np.ndarray, side: np.ndarray, place: np.ndarray, few: np.ndarray, tally: np.ndarray) -> list[tuple[int, int]]:
    """The links of all places of at most FEW fingerprints, which lie one behind another: neighbours at each distance at once."""
    out: list[tuple[int, int]] = []
    for k in range(1, FEW):
        i = np.flatnonzero(few[:-k] & (place[:-k] == place[k:]) & ((side[:-k] < 0) | (side[:-k] != side[k:]))) if k < len(fp) else np.zeros(0, int)
        tally[0] += len(i)
        i = i[(np.abs(table[i].astype(np.int16) - table[i + k]) <= RADIUS).all(axis=1)]
        tally[1] += len(i)
        i = i[np.bitwise_count(fp[i].astype(np.uint64) ^ fp[i + k].astype(np.uint64)) <= RADIUS]
        tally[2] += len(i)
        out += zip(fp[i].tolist(), fp[i + k].tolist(), strict=True)
    return out


def _linker(batches: Iterator[pd.DataFrame], report: bool = False) -> Iterator[pd.DataFrame]:
    """Meeting places lie one behind another; each is compared when its last row is there. report: their tallies instead of links."""
    names = ["choice", "bits", "a", "b"]
    rest: pd.DataFrame | None = None

    def places(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame[names].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(frame)]])
        fp, side = frame["fp"].to_numpy(np.int64), frame["side"].to_numpy()
        table = np.stack([frame[c].to_numpy(np.int64) for c in sorted(c for c in frame if c[0] == "t")], axis=1).view(np.uint8)
        size = ends - starts
        tally = np.zeros(3, np.int64)
        out = _few(fp, table, side, np.repeat(np.arange(len(size)), size), np.repeat(size, size) <= FEW, tally)
        for lo, hi in zip(starts[size > FEW], ends[size > FEW], strict=True):
            out += _forest(fp[lo:hi], table[lo:hi], side[lo:hi], tally)
        if report:
            return pd.DataFrame([tally], columns=["met", "left", "linked"])
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(frame):
            continue
        last = (frame[names] == frame[names].iloc[-1]).all(axis=1).to_numpy()
        at = len(frame) - int(last[::-1].argmin()) if not last.all() else 0
        if at:
            yield places(frame.iloc[:at])
        rest = frame.iloc[at:]
    if rest is not None and len(rest):
        yield places(rest)


def _meetings(fps: DataFrame) -> DataFrame:
    """Rows of the pivot table in their meeting places, which lie one behind another in a partition."""
    table = pivot_table(fps.select("fp"))
    places = cut(meeting_places(table, _groups(fps.count())))
    hot = cut(places.groupBy("choice", "bits").count().filter(F.col("count") > PLACE))
    own = [F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(-1).alias("side")]
    if hot.isEmpty():
        rows = places.select("*", *own)
    else:
        # Parts of half a place's size; each pair of parts is a place of its own.
        dealt = places.join(hot.select("choice", "bits", F.ceil(F.col("count") / (PLACE // 2)).cast("int").alias("parts")), ["choice", "bits"], "left")
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(part, o).alias("a"), F.greatest(part, o).alias("b"), F.when(part == o, F.lit(-1)).otherwise((part > o).cast("int")).alias("side")))
        split = dealt.filter("parts is not null").select(*places.columns, F.explode(pair).alias("p")).select(*places.columns, "p.a", "p.b", "p.side")
        rows = dealt.filter("parts is null").select(*places.columns, *own).unionByName(split)
    n = partitions(fps.sparkSession)
    return rows.repartition(n, "choice", "bits", "a", "b").sortWithinPartitions("choice", "bits", "a", "b")


def links(fps: DataFrame) -> DataFrame:
    """src and dst: links that connect every two distinct fingerprints (fp) which chains of links of at most RADIUS bits connect."""
    return _meetings(fps).mapInPandas(_linker, "src long, dst long")


def pair_report(fps: DataFrame) -> DataFrame:
    """One row of sums over meeting places, where a pair may meet more than once: pairs that met, that the table left, and that the bits verified."""
    tallies = _meetings(fps).mapInPandas(lambda batches: _linker(batches, True), "met long, left long, linked long")
    return tallies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "left", "linked")])


def _labels(first: DataFrame) -> DataFrame:
    """first (fp once each, and more) with component: one fingerprint of those that links connect it to."""
    return first.join(connected_components(links(first)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id reachable) of every row."""
    rows = cut(fingerprints(docs, id_col, text_col, n))
    joined = _labels(cut(rows.groupBy("fp").agg(F.min("doc_id").alias("doc"))))
    least = joined.groupBy("component").agg(F.min("doc").alias("component_id"))
    labels = joined.join(least, "component").select("fp", "component_id")
    return rows.join(labels, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """One row of docs for each component: the one of the least id, rows without an id last, then of the least hash of its text.

    Rows of different components stay, whether they share an id or have none.
    """
    none, own, text_hash = _keys(id_col, text_col)
    rows = cut(docs.select(none.alias("none"), own.alias("id"), text_hash.alias("text_hash"), _fingerprint(n)(F.col(text_col).cast("string")).alias("fp")))
    best = F.min(F.struct("none", "id", "text_hash")).alias("b")
    first = cut(rows.groupBy("fp").agg(best))
    kept = _labels(first).groupBy("component").agg(F.min("b").alias("b")).select("b.*")
    keys = free_names(docs, "none", "id", "text_hash")
    keyed = docs.withColumns(dict(zip(keys, _keys(id_col, text_col), strict=True)))
    # The semi join and the removal of repeated rows need one exchange of the texts.
    return keyed.join(kept.toDF(*keys), keys, "left_semi").dropDuplicates(keys).select(docs.columns)
