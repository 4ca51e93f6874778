"""Sharding by minimax contiguous partition of ordered atomic groups.

Groups (equal texts) stand in the order of their smallest id. The smallest capacity for which a greedy pass needs
no more than the wanted shards is found by binary search, and the groups are cut there.

The group sizes stay distributed. The driver holds some true group boundaries (prefix sums), a few thousand at
first. For a capacity, cutting at the last known boundary is a partition (so it proves that the capacity is
enough), and cutting at the capacity itself is the best that any partition can do (so it can prove that the
capacity is too small). Where neither decides, only the gaps that the cuts fall into are split further, by one
aggregation that returns a bounded number of rows; so the search is exact without collecting the sizes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, partitions, ranked, table, temporary

#: Boundaries asked for at first, and for each gap that is split.
FIRST, SPLIT = 4096, 256


class Boundaries:
    """Known boundaries of the ordered groups; ``closed[i]``: no group ends between ends[i] and ends[i + 1]."""

    def __init__(self, prefixes: DataFrame, total: int) -> None:
        self.prefixes, self.total, self.ends, self.closed = prefixes, total, [0, total], {0: False}
        self.split([0], FIRST)

    def split(self, gaps: list[int], parts: int) -> None:
        """Asks for the smallest and largest boundary in each of ``parts`` equal parts of the gaps (indices into ends)."""
        spans = [(self.ends[i], self.ends[i + 1]) for i in gaps]
        part = F.lit(None).cast("long")
        for k, (a, b) in enumerate(spans):
            width = max(1, -(-(b - a) // parts))
            inside = (F.col("prefix") > a) & (F.col("prefix") <= b)
            part = F.when(inside, F.lit(k * (parts + 1)) + F.floor((F.col("prefix") - a - 1) / F.lit(width))).otherwise(part)
        found = self.prefixes.withColumn("part", part).filter("part is not null").groupBy("part")
        rows = found.agg(F.min("prefix").alias("a"), F.max("prefix").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # at most gaps * (parts + 1)
        known = dict(zip(self.ends[1:], [self.closed[i] for i in range(len(self.ends) - 1)]))
        for r in rows:
            known[r["b"]] = r["n"] <= 2
            known[r["a"]] = True
        self.ends = [0, *sorted(known)]
        self.closed = {i: known[b] for i, b in enumerate(self.ends[1:])}

    def cuts(self, capacity: int, shards: int, low: bool) -> tuple[list[float], list[int]]:
        """Greedy cuts with the gaps that they fall into: at known boundaries (low), or as far as could be."""
        at, cuts, gaps = 0, [], []
        for _ in range(shards):
            limit = at + capacity
            if limit >= self.total:
                cuts.append(self.total)
                break
            i = bisect_right(self.ends, limit) - 1
            if not self.closed[i]:
                gaps.append(i)
            at = self.ends[i] if low or self.closed[i] else limit
            cuts.append(at)
        return cuts, gaps

    def smallest(self, shards: int, largest: int) -> list[int]:
        """The cuts of the smallest feasible capacity; ``largest`` is the largest group."""
        lo, hi = max(largest, -(-self.total // shards)) - 1, self.total  # lo can't do, hi can
        while hi - lo > 1:
            mid = (lo + hi) // 2
            low, gaps_low = self.cuts(mid, shards, True)
            high, gaps_high = self.cuts(mid, shards, False)
            if low[-1] == self.total:
                hi = mid
            elif high[-1] < self.total:
                lo = mid
            else:
                open_gaps = {i for a, b in zip(low, high) for i in range(max(0, bisect_left(self.ends, a) - 1), bisect_right(self.ends, b)) if not self.closed.get(i, True)}
                self.split(sorted({*gaps_low, *gaps_high} | set(sorted(open_gaps)[:64])), SPLIT)
        while True:
            low, gaps = self.cuts(hi, shards, True)
            if not gaps:
                return low
            self.split(sorted(set(gaps)), SPLIT)


def minimax_cuts(groups: DataFrame, order: str, size: str, shards: int) -> tuple[DataFrame, list[int]]:
    """``groups`` with ``prefix`` (sum of sizes up to and with each group, along ``order``), and the prefix at which
    each shard ends. Sizes are positive; ``order`` is unique but for nulls, which come first in any order."""
    n = max(2, partitions(groups.sparkSession))
    dealt = table(groups.repartitionByRange(n, F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(size).alias("_sum"))  # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    so_far = Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first(), size).rowsBetween(Window.unboundedPreceding, 0)
    prefixes = table(
        dealt.withColumn("_own", F.sum(size).over(so_far)).join(F.broadcast(offsets), "_range")
        .withColumn("prefix", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_range")
    )
    total, largest = prefixes.agg(F.sum(size), F.max(size)).first()
    if not total:
        return prefixes, []
    return prefixes, Boundaries(prefixes, int(total)).smallest(shards, int(largest))


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1 (null: 1). Rows with equal texts (null equals empty) share a shard, so the
    largest shard is as small as groups that stay whole, in order, allow. slot counts from 0 in each shard. Null
    ids come first in their group; repeated rows take one slot each. Shards can stay empty if groups are few or
    one is large; an empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    with temporary() as made:
        docs = table(
            df.select(
                F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_key"),
            )
        )
        groups = table(docs.groupBy("_key").agg(F.min("_id").alias("_first"), F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n")))
        prefixes, cuts = minimax_cuts(groups, "_first", "_size", shards)
        place = F.lit(0)
        for end in cuts[:-1]:
            place = place + F.when(F.col("prefix") > end, 1).otherwise(0)
        placed = prefixes.select("_key", "_n", place.alias("shard"), F.col("prefix").alias("_prefix"))
        rows = attach(docs, placed, "_key", "_n").drop("_key")
        # repeated rows are told apart by a number that is fixed once the table is written
        numbered = ranked(rows.withColumn("_tie", F.monotonically_increasing_id()), ["shard"], ["_prefix", "_id", "_tie"], "slot")
        made.keep(made.tables[-1])  # the rows dealt out for their slots, which alone are still read
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
