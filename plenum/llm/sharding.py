"""Sharding by k-d tree partitioning, in DataFrame functions alone.

Every node of a level is split at the weighted median (by bytes) of its widest metadata dimension, until
leaves reach the target bytes. Ties are parted by the document id, then by the text's checksum, then by the row's
place in the written table, so neither a hot value nor a hot or missing id keeps a node whole. The medians of all nodes of a level come from the same few passes over a narrow table: each pass
sums bytes by node and bucket and narrows every node's range to the bucket that holds its median.
The driver sees at most nodes times BUCKETS sums at once; what it knows of the nodes goes back as arrays
in the plan, so that no pass joins anything.

Dimensions are integers: dense ranks of the text columns, and numbers as they are.

Defined cases: ids are whole numbers of 64 bits, or missing; null metadata is -1 and a null text has size 1; rows of one id may lie on
either side of a median; a text of any length is one row, which no split divides;
an empty table gives no row; slots are in the order of the ids; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.storage import cut, partitions

#: Buckets of a node's range in each pass.
BUCKETS = 256
#: Rows that one task numbers within a shard.
SLOT_ROWS = 20_000
#: Distinct values of a text column that one task ranks; more are ranked in ranges.
RANKED = 100_000
#: What parts rows of equal values, in this order; places are distinct.
TIES = ["doc_id_", "text_crc32", "place_"]
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def ranks(values: DataFrame, c: str) -> DataFrame:
    """c and _rank: the values of c, which are distinct and not null, numbered from 0 in their order."""
    if values.count() <= RANKED:
        return values.select(c, (F.row_number().over(Window.orderBy(c)) - 1).cast("long").alias("_rank"))
    ranges = cut(values.repartitionByRange(partitions(values.sparkSession), c).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(c)) - 1
    return ranges.withColumn("_own", own).join(F.broadcast(starts), "_range").select(c, (F.col("_start") + F.col("_own")).cast("long").alias("_rank"))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, the ranks of the categories and length, in a narrow table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[F.col(c).cast("string").alias(c) for c in categories],
    )
    narrow = cut(narrow)
    for c in categories:
        values = cut(narrow.filter(F.col(c).isNotNull()).select(c).distinct())
        narrow = narrow.join(ranks(values, c), c, "left").drop(c).withColumn(f"d_{c}", F.coalesce("_rank", F.lit(-1))).drop("_rank")
    return narrow.withColumn("d_length", F.col("size")).withColumn("doc_id_", F.coalesce("doc_id", F.lit(LEAST)))


def of_node(values: dict[int, int], kind: str = "bigint") -> Column:
    """The value of each row's node; null for nodes that have none."""
    listed = [F.lit(values.get(n)).cast(kind) for n in range(max(values, default=0) + 1)]
    return F.get(F.array(*listed), F.col("node").cast("int"))


def _medians(rows: DataFrame, low: dict[int, int], high: dict[int, int], before: dict[int, int], half: dict[int, float]) -> dict[int, tuple[int, int]]:
    """For each node the least value x up to which its rows hold at least half its bytes, and the bytes below x.

    rows: node, x, w. Passes go on until every range is a single value.
    """
    while open_nodes := [n for n in low if low[n] < high[n]]:
        step = {n: (high[n] - low[n]) // BUCKETS + 1 for n in open_nodes}
        bound = rows.withColumn("lo", of_node({n: low[n] for n in open_nodes})).withColumn("hi", of_node({n: high[n] for n in open_nodes})).withColumn("step", of_node(step))
        offset = F.col("x").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")
        bucket = F.floor(offset / F.col("step").cast("decimal(20,0)")).cast("long")
        inside = bound.filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in inside.groupBy("node", bucket.alias("b")).agg(F.sum("w").alias("w")).collect():
            sums.setdefault(r["node"], []).append((r["b"], r["w"]))
        for n in open_nodes:
            for b, w in sorted(sums[n]):
                if before[n] + w >= half[n]:
                    low[n], high[n] = low[n] + b * step[n], min(high[n], low[n] + (b + 1) * step[n] - 1)
                    break
                before[n] += w
    return {n: (low[n], before[n]) for n in low}


def kd_tree(rows: DataFrame, leaves: int, dimensions: list[str]) -> DataFrame:
    """rows with the leaf (0 to leaves - 1) of each. leaves is a power of two; rows are written, so places are the same whenever they are read."""
    rows = rows.withColumn("node", F.lit(0).cast("long")).withColumn("place_", F.monotonically_increasing_id())
    spread: dict[str, float] = {}
    for _ in range(leaves.bit_length() - 1):
        stats = rows.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{k}_{d}") for d in dimensions for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        if not spread and stats:
            spread = {d: max(1, stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) for d in dimensions}
        widest = {r["node"]: max(dimensions, key=lambda d, r=r: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / spread[d], -dimensions.index(d))) for r in stats}
        half = {r["node"]: r["w"] / 2 for r in stats}
        dim = of_node({n: dimensions.index(d) for n, d in widest.items()}, "int")
        own = rows.withColumn("x", F.coalesce(*[F.when(dim == k, F.col(d)) for k, d in enumerate(dimensions)]))
        low = {r["node"]: r[f"lo_{widest[r['node']]}"] for r in stats}
        high = {r["node"]: r[f"hi_{widest[r['node']]}"] for r in stats}
        medians = _medians(own.select("node", "x", F.col("size").alias("w")), low, high, dict.fromkeys(low, 0), half)
        own = own.withColumn("cut", of_node({n: x for n, (x, _) in medians.items()}))
        # Rows that have the median itself are parted by the first tie breaker, those that have its median by the next.
        right, tied, below = F.col("x") > F.col("cut"), F.col("x") == F.col("cut"), medians
        for t in TIES:
            same = own.filter(tied).select("node", F.col(t).alias("x"), F.col("size").alias("w"))
            ends = same.groupBy("node").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
            below = _medians(same, {r["node"]: r["lo"] for r in ends}, {r["node"]: r["hi"] for r in ends}, {n: b for n, (_, b) in below.items()}, half)
            own = own.withColumn(f"cut{t}", of_node({n: x for n, (x, _) in below.items()}))
            right, tied = right | (tied & (F.col(t) > F.col(f"cut{t}"))), tied & (F.col(t) == F.col(f"cut{t}"))
        rows = cut(own.withColumn("node", 2 * F.col("node") + right.cast("long")).drop("x", "cut", *[f"cut{t}" for t in TIES]))
    return rows.withColumnRenamed("node", "leaf")


def numbered(rows: DataFrame, shard: str, order: list[Column]) -> DataFrame:
    """rows with slot: 0, 1, ... within each shard, in the order given. Ranges of about SLOT_ROWS rows are numbered each in a task, after those before them.

    rows are written: equal ones are parted by their place.
    """
    keys = [F.col(shard), *order, F.col("_m")]
    ranges = max(1, partitions(rows.sparkSession), rows.count() // SLOT_ROWS)
    rows = cut(rows.withColumn("_m", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard, "_range").count().select(shard, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # a row for each range of a shard
    within = Window.partitionBy(shard, "_range").orderBy(*order, "_m")
    return rows.withColumn("_k", F.row_number().over(within)).join(starts, [shard, "_range"]).withColumn("slot", F.col("_start") + F.col("_k") - 1).drop("_range", "_k", "_start", "_m")


def _shards(rows: DataFrame, leaves: int, categories: tuple[str, ...]) -> DataFrame:
    tree = kd_tree(rows, leaves, [*[f"d_{c}" for c in categories], "d_length"])
    out = numbered(tree.withColumn("shard", F.col("leaf").cast("int")), "shard", [F.col("doc_id_"), F.col("size"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_to_target(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; sizes are near equal (law bytes).

    Nodes are split until leaves hold about target_bytes at most. shards, a power of two, sets the target to that share of all bytes.
    """
    rows = cut(metadata(docs, id_col, text_col, categories))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    leaves = shards_for(total, -(-total // shards) if shards else target_bytes)
    return _shards(rows, leaves, categories)


def shards_for(total_bytes: int, target_bytes: int) -> int:
    """Leaves so that each holds about target_bytes at most: the least power of two."""
    return 1 << (max(1, -(-total_bytes // max(1, target_bytes))) - 1).bit_length()
