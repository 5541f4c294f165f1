"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Each source has a weight; the mix has a budget of words, shared by weight. A source whose share is more than
EPOCHS times its size is clamped there, and what it cannot take is shared by the weights of the others, until no
share is above. A source then gives as many whole passes as fit its target, and of one more pass what is left: its
documents in the order of a seeded hash, as far as the words go, the last of them in part. So the words taken
from a source are its target, rounded, whatever the lengths of its documents.

The words of that last pass are found by digits: sums by twelve bits of the hash tell the bucket in which they end, that
bucket is parted by the next twelve, and so on until few rows are left, which a window puts in order. No source is
sorted, and a source of any share of the rows is summed in parts.

The driver and a broadcast hold one row a source; more than SOURCES of them are refused.

Defined cases: null and empty texts have no words and are taken zero times; a null source is a source, the last; rows
without an id, or with a repeated one, are documents like any other, and which of wholly equal rows is taken in the last
pass is left open; texts of any length count whole; a table without words has targets of zero; an empty table
gives no row; columns of the table other than the three named play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.storage import cut

EPOCHS, SEED = 3, 42
#: Sources that the driver and a broadcast hold, at about 100 octets each.
SOURCES = 200_000
#: Rows of a source that a window puts in order; digits are taken until no more are left.
ORDERED = 20_000
#: Bits of a digit, and where the digits stand: in the hash, then in the row's number, which tells equal hashes apart.
DIGIT = 12
PLACES = [("key", s) for s in (48, 36, 24, 12, 0)] + [("row", s) for s in (52, 40, 28, 16, 4)]


def n_words(text: Column) -> Column:
    """Runs of characters other than space and the five controls from tab."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def cycled(sources: list[str | None], weights: tuple[int, ...] = (1, 2, 3)) -> list[int]:
    """The weights in turn, for sources in order."""
    return [weights[k % len(weights)] for k in range(len(sources))]


def water_fill(sizes: list[int], weights: list[int], budget: int, epochs: int = EPOCHS) -> list[Fraction]:
    """Targets: the budget by weight, none above epochs times its size; exact. What no source can take is left."""
    targets = [Fraction(0)] * len(sizes)
    free = [k for k, w in enumerate(weights) if w > 0]
    left = Fraction(budget)
    while free:
        level = left / sum(weights[k] for k in free)
        full = {k for k in free if weights[k] * level > epochs * sizes[k]}
        for k in full or free:
            targets[k] = Fraction(epochs * sizes[k]) if full else weights[k] * level
            left -= targets[k]
        free = [k for k in free if k not in full] if full else []
    return targets


def _digit(place: int) -> Column:
    column, shift = PLACES[place]
    return F.shiftrightunsigned(F.col(column), shift).bitwiseAND((1 << DIGIT) - 1)


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Each document's words, its place in the seeded order, and a number for its row."""
    text, own = F.col(text_col).cast("string"), F.col(id_col)
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), own.cast("string"), text)), 1, 15), 16, 10).cast("long")
    return docs.select(own.alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"))


class _Pass:
    """How far a source's last pass goes: the digits of the bucket in which it ends, and the words still to take there."""

    def __init__(self, rest: int):
        self.digits: list[int] = []
        self.rest = rest
        self.rows: int | None = None  # in that bucket, once known


def _plan(spark, passes: dict[int, _Pass], level: int) -> DataFrame:
    digits = "".join(f", b{k} int" for k in range(level))
    rows = [(s, p.rest, *[p.digits[k] if k < len(p.digits) else -1 for k in range(level)]) for s, p in passes.items()]
    return F.broadcast(spark.createDataFrame(rows, f"s int, rest long{digits}"))


def _place(level: int) -> tuple[Column, Column]:
    """Whether a row lies before its source's bucket, and whether in it."""
    before, within = F.lit(False), F.lit(True)
    for k in range(level):
        before = before | (within & (_digit(k) < F.col(f"b{k}")))
        within = within & (_digit(k) == F.col(f"b{k}"))
    return before, within


def _narrow(numbered: DataFrame, passes: dict[int, _Pass]) -> int:
    """Finds each pass's last bucket; returns the number of digits that were needed."""
    spark = numbered.sparkSession
    for level in range(len(PLACES)):
        wide = {s: p for s, p in passes.items() if p.rest > 0 and (p.rows is None or p.rows > ORDERED)}
        if not wide:
            return level
        _, within = _place(level)
        open_rows = numbered.join(_plan(spark, wide, level), "s").filter(within & (F.col("size") > 0))
        sums = open_rows.groupBy("s", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("rest").alias("rest"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("digit")))
        ends = upto.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        for r in ends.select("s", "digit", "n", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")).collect():  # one row a source
            p = passes[r["s"]]
            p.digits.append(r["digit"])
            p.rest, p.rows = r["rest"], r["n"]
    return len(PLACES)


def mix(
    docs: DataFrame, weigh: Callable[[list[str | None]], list[int]] = cycled, budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words of each document, of its source, the words that the mix is to take
    of the source, and those it takes of the document, repeats counted. weigh gives the weights of the sources, which it gets in the order of
    their code points, null last. budget: words of the mix; None: as many as the table has."""
    spark = docs.sparkSession
    base = cut(_measured(docs, id_col, text_col, source_col, seed))
    found = base.groupBy("source").agg(F.sum("size").alias("size")).limit(SOURCES + 1).collect()  # one row a source
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"]))
    sizes = [r["size"] for r in found]
    targets = water_fill(sizes, weigh([r["source"] for r in found]), sum(sizes) if budget is None else budget, epochs)
    quotas = [min(epochs * n, int(t + Fraction(1, 2))) for n, t in zip(sizes, targets, strict=True)]
    whole = [q // n if n else 0 for q, n in zip(quotas, sizes, strict=True)]
    passes = {s: _Pass(q - w * n) for s, (q, w, n) in enumerate(zip(quotas, whole, sizes, strict=True))}

    table = spark.createDataFrame([(s, r["source"], sizes[s], float(targets[s]), whole[s]) for s, r in enumerate(found)], "s int, name string, source_size long, target double, whole long")
    numbered = base.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    level = _narrow(numbered.select("s", "size", "key", "row"), passes)
    before, within = _place(level)
    placed = numbered.join(_plan(spark, passes, level), "s").withColumn("open", within & (F.col("rest") > 0) & (F.col("size") > 0)).withColumn("extra", F.when(before, F.col("size")).otherwise(0))
    order = Window.partitionBy("s").orderBy("key", "doc_id", "row")
    last = placed.filter("open").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.sum("size").over(order) + F.col("size"))))
    both = placed.filter(~F.col("open")).unionByName(last)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def repetitions(mixed: DataFrame) -> DataFrame:
    """A row for each time that the mix takes a document, whole or in part: doc_id, source, repetition (from 0) and words, those of it that are taken."""
    times = F.when(F.col("taken") > 0, F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = mixed.select("doc_id", "source", "size", "taken", F.explode(times).alias("repetition"))
    return rows.select("doc_id", "source", "repetition", F.least(F.col("size"), F.col("taken") - F.col("repetition") * F.col("size")).alias("words"))
