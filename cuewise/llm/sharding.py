"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by their smallest doc_id (ties: SHA-256 of the text); a group is never cut. The smallest feasible
capacity is found by binary search with a greedy check over the groups' running sizes, and the cuts
are those of the greedy run at that capacity.

The running sizes stay distributed. The driver holds a sketch of them: some known cut positions, and
for each gap between two whether more lie inside. On the sketch, a greedy run over known positions only
bounds the capacity from above and one that may stop anywhere inside an unknown gap bounds it from
below. Gaps that either run touches are resolved 64-fold by one aggregation; the rounds end when both
runs agree, so the answer is exact while at most GAPS * 64 rows reach the driver a round.

Defined cases: null text has size 8 and is in the group of the empty text; a null doc_id ranks first, and rows that share a
doc_id, however many, are ordered by SHA-256 of their texts; very long texts count whole; repeated rows are rows of one group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import durable, join_groups, order_key, range_bins

SHARDS = 24
ROWS_PER_BIN = 20_000
FIRST, EACH, GAPS = 4096, 64, 1024


class Sketch:
    """Known running sizes, ascending; ``open`` holds i if unknown ones lie between known[i-1] and known[i]."""

    def __init__(self, total: int) -> None:
        self.known = [total]
        self.gaps = {total}  # by the known position that ends the gap

    def after(self, base: int, capacity: int, hopeful: bool) -> tuple[int, int | None]:
        """Where a greedy shard from ``base`` ends, and the end of the unknown gap it ran into."""
        limit = base + capacity
        i = bisect_right(self.known, limit)
        if i == len(self.known):
            return self.known[-1], None
        low, high = (self.known[i - 1] if i else 0), self.known[i]
        gap = high if high in self.gaps else None
        return (limit if hopeful and gap else low), gap

    def run(self, capacity: int, shards: int, hopeful: bool) -> tuple[list[int], set[int]] | None:
        """The cuts of a greedy run and the gaps it met; None if ``shards`` don't suffice."""
        ends, met, base = [], set(), 0
        while base < self.known[-1]:
            end, gap = self.after(base, capacity, hopeful)
            if gap:
                met.add(gap)
            if end <= base or len(ends) == shards:
                return None
            ends.append(end)
            base = end
        return ends, met

    def least(self, shards: int, hopeful: bool) -> int:
        low, high = 1, self.known[-1]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.run(mid, shards, hopeful) else (mid + 1, high)
        return low

    def touched(self, shards: int) -> tuple[list[int], set[int]]:
        """The cuts at the least sure capacity, and the gaps that keep them from being proven."""
        high, low = self.least(shards, False), self.least(shards, True)
        sure, hope = self.run(high, shards, False), self.run(low, shards, True)
        if low == high and sure[0] == hope[0]:
            return sure[0], set()
        met, edges = sure[1] | hope[1], self.run(high, shards, True)
        met |= edges[1]
        for a, b in zip(sure[0], edges[0], strict=False):
            for end in self.known[bisect_left(self.known, min(a, b)) : bisect_right(self.known, max(a, b)) + 1]:
                if end in self.gaps and len(met) < GAPS:
                    met.add(end)
        return sure[0], set(sorted(met)[:GAPS])

    def refine(self, ends: set[int], parts: list[tuple[int, int, int, int]]) -> None:
        """``parts``: (end of the gap, first, last, count) of the running sizes in each part of a gap."""
        self.gaps -= ends
        new = set(self.known)
        for _, first, last, count in parts:
            new |= {first, last}
            if count > 2:
                self.gaps.add(last)
        self.known = sorted(new)


def minimax_cuts(running: DataFrame, total: int, shards: int) -> list[int]:
    """The running sizes after which to cut. ``running`` has the column ``upto``: each group's running size."""
    if total <= 0:
        return []
    sketch = Sketch(total)
    parts, ends = FIRST, {total}
    while ends:
        gaps = [(sketch.known[i - 1] if (i := bisect_left(sketch.known, e)) else 0, e) for e in sorted(ends)]
        sketch.refine(ends, _summed(running, gaps, parts))
        parts = EACH
        cuts, ends = sketch.touched(shards)
    return cuts


def _summed(running: DataFrame, gaps: list[tuple[int, int]], parts: int) -> list[tuple[int, int, int, int]]:
    """One aggregation over the running sizes strictly inside the gaps; at most len(gaps) * parts rows."""
    from pyspark.ml.feature import Bucketizer

    spark = running.sparkSession
    edges = sorted({x for g in gaps for x in g})
    splits = [-math.inf, *map(float, edges), math.inf]
    at = Bucketizer(splits=splits, inputCol="__at", outputCol="__gap").transform(running.select("upto", F.col("upto").cast("double").alias("__at")))
    # Bucket i + 1 starts at edges[i]. At most GAPS rows: a bounded broadcast.
    rows = spark.createDataFrame([(float(edges.index(a) + 1), a, b) for a, b in gaps], "gap double, low long, high long")
    inside = at.join(F.broadcast(rows), F.col("__gap") == F.col("gap")).where("upto > low and upto < high")
    part = F.floor((F.col("upto") - F.col("low")).cast("double") * parts / (F.col("high") - F.col("low"))).cast("int")
    found = inside.groupBy("high", part.alias("part")).agg(F.min("upto").alias("a"), F.max("upto").alias("b"), F.count("*").alias("n"))
    return [(r["high"], r["a"], r["b"], r["n"]) for r in found.collect()]


def leading(key: Column) -> Column:
    """The first six bytes of a binary as a double in [0, 1), in the same order."""
    return F.conv(F.hex(F.substring(key, 1, 6)), 16, 10).cast("double") / 2.0**48


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null), group_rows.

    Slots count the rows of a shard in order of doc_id, equal rows in any order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        order_key("doc_id").alias("at"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    rows = durable(range_bins(durable(rows), "at", ROWS_PER_BIN, leading(F.col("key"))))
    groups = rows.groupBy("key").agg(F.min("at").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("group_rows"), F.min("bin").alias("bin"))
    groups = durable(groups)

    # Running sizes in two steps: within bins of the ordering, and over the bins' totals.
    ahead = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = groups.groupBy("bin").agg(F.sum("bytes").alias("__b")).select("bin", F.coalesce(F.sum("__b").over(ahead), F.lit(0)).alias("__off"))
    within = Window.partitionBy("bin").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, 0)
    running = durable(groups.withColumn("__in", F.sum("bytes").over(within)).join(totals, "bin").select("key", "group_rows", (F.col("__in") + F.col("__off")).alias("upto")))
    total = running.agg(F.max("upto")).first()[0] or 0
    cuts = minimax_cuts(running, total, shards)

    shard = reduce(lambda a, b: a + b, [(F.col("upto") > F.lit(c)).cast("int") for c in cuts[:-1]], F.lit(0))
    placed = join_groups(rows, running.select("key", "group_rows", shard.alias("shard")), "key", "group_rows", rows.count())

    # Slots likewise: a rank within (bin, shard), and the rows of the shard in earlier bins.
    placed = durable(placed)
    earlier = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("bin", "shard").agg(F.count("*").alias("__n")).select("bin", "shard", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    rank = F.row_number().over(Window.partitionBy("bin", "shard").orderBy("at", "key"))
    return placed.withColumn("__r", rank).join(counts, ["bin", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__r") - 1 + F.col("__off")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_rows"
    )
