"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all rows of one text; it never splits.  Groups of at least ``1 / (shards * GRAIN)`` of all
bytes are items of their own, of which there can be at most ``shards * GRAIN``.  Smaller groups
join one of ``LOTS`` lots by hash, each an item.  So the packing sees a bounded number of items at
any input size: sorted by size, each enters the bin with the tightest remaining capacity, found in a
balanced tree of the gaps.  For a fixed number of shards the smallest capacity that needs no more
bins is found by bisection, which leaves the sizes near equal.  A group larger than a fair share
fills its own shard and sets that capacity.

Null text counts as no bytes; texts may be of any length.  Ties go by key, so results repeat.  Repeated rows are rows of one group
and get slots of their own.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.llm.scratch import materialise, table

GRAIN = 2048
LOTS = 16384


class GapTree:
    """Remaining capacities in order: a two-level balanced tree of leaves with at most ``WIDTH`` gaps."""

    WIDTH = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.highest: list[tuple[int, int]] = []

    def add(self, gap: int, bin_: int) -> None:
        x = (gap, bin_)
        if not self.leaves:
            self.leaves, self.highest = [[x]], [x]
            return
        i = min(bisect_left(self.highest, x), len(self.leaves) - 1)
        leaf = self.leaves[i]
        insort(leaf, x)
        if len(leaf) > self.WIDTH:
            half = len(leaf) // 2
            self.leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self.highest[i : i + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.highest[i] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest gap that holds ``size``."""
        i = bisect_left(self.highest, (size, -1))
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        x = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.highest[i] = leaf[-1]
        else:
            del self.leaves[i], self.highest[i]
        return x


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size (given largest first); None once more than ``most`` bins are needed."""
    tree, bins, n = GapTree(), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if n == most:
                return None
            found, n = (capacity, n), n + 1
        bins.append(found[1])
        tree.add(found[0] - size, found[1])
    return bins


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Bins 0..shards-1 for sizes in descending order, at the smallest capacity that suffices."""
    if not sizes:
        return []
    low = max(-(-sum(sizes) // shards), sizes[0])
    high = max(2 * low, low + sizes[0])
    best = best_fit_decreasing(sizes, high, shards)
    while low < high:
        mid = (low + high) // 2
        got = best_fit_decreasing(sizes, mid, shards)
        if got is None:
            low = mid + 1
        else:
            high, best = mid, got
    return best


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.spark_partition_id().alias("part"),
        ),
        "shard-rows",
    )
    key = ["h", "text_crc32", "size"]
    groups = materialise(rows.groupBy(*key).agg((F.count(F.lit(1)) * F.col("size")).alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, -(-total // (shards * GRAIN)))
    lot = F.pmod(F.xxhash64("h", "size"), F.lit(LOTS)).cast("int")
    large = [(r["bytes"], (0, r["h"], r["text_crc32"], r["size"])) for r in groups.where(F.col("bytes") >= least).collect()]
    small = [(r["bytes"], (1, r["lot"], 0, 0)) for r in groups.where(F.col("bytes") < least).groupBy(lot.alias("lot")).agg(F.sum("bytes").alias("bytes")).collect()]
    items = sorted(large + small, key=lambda x: (-x[0], x[1]))
    bins = pack_into([x[0] for x in items], shards)
    of_large = [(*k[1:], b) for (_, k), b in zip(items, bins, strict=True) if k[0] == 0]
    of_lot = [(k[1], b) for (_, k), b in zip(items, bins, strict=True) if k[0] == 1]
    large_df = spark.createDataFrame(of_large, "h long, text_crc32 long, size long, s0 int")
    lot_df = spark.createDataFrame(of_lot, "lot int, s1 int")
    placed = (
        rows.withColumn("lot", lot)
        .join(F.broadcast(large_df), key, "left")  # at most shards * GRAIN rows
        .join(F.broadcast(lot_df), "lot", "left")  # at most LOTS rows
        .select("doc_id", "size", "text_crc32", "part", F.coalesce("s0", "s1").alias("shard"))
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        placed.withColumn("r", F.row_number().over(inside))
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("r") - 1).alias("slot"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
