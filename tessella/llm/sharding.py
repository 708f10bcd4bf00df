"""Sharding by a minimax contiguous partition of atomic groups.

Rows with equal texts form a group that is never split. Groups stand in the order of their smallest doc_id, those that
share it (or have none) in that of their texts' digests, both in one number; the shards are consecutive runs of groups, and the capacity is the smallest for which that many shards suffice. It is found by
binary search, each capacity checked greedily; the cuts keep that capacity and share out the slack that it leaves.

Greedy checks need prefix sums over all groups, which are too many for one place. The driver sees only a table of at
most ``BLOCKS`` blocks (intervals of the order key with their sums, combined in Spark). A capacity is then either
certainly enough (cuts between blocks suffice), certainly too small (even cuts inside blocks would not do) or between.
The blocks where a cut can fall at such a capacity, and no others, are split further, so every round narrows the
intervals by the number of blocks until each of them holds one key. That bounds the rounds by the width of the key, whatever the
distribution, and a hot group is a single sum from the start.

Defined results for odd input: a null text counts as the empty one and is grouped with it; a null doc_id stands after
all others; groups that share their smallest doc_id, or have none, are cut apart like all others; repeated rows get
slots of their own; an empty table gives an empty table; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import materialize, small

BLOCKS = 65_536
OVERHEAD = 16
#: Rows that share one slot counter.
SLOT_ROWS = 1000


class Blocks:
    """Consecutive blocks of the order key: first and last key, sum of sizes."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.rows = rows
        self.ends = np.cumsum([0, *(r[2] for r in rows)], dtype=np.int64)
        self.atomic = np.array([r[0] == r[1] for r in rows])
        self.total = int(self.ends[-1])

    def down(self, v: int) -> int:
        """The last boundary between blocks that is not after ``v``."""
        return int(self.ends[np.searchsorted(self.ends, v, side="right") - 1])

    def inside(self, v: int) -> int:
        """The same, with cuts allowed anywhere in a block of several keys."""
        k = int(np.searchsorted(self.ends, v, side="right")) - 1
        return v if k < len(self.rows) and not self.atomic[k] else int(self.ends[k])

    def greedy(self, capacity: int, shards: int, place) -> list[int]:
        """Where each shard ends if it takes as much as fits."""
        at, cuts = 0, []
        for _ in range(shards):
            at = min(place(min(at + capacity, self.total)), self.total)
            cuts.append(at)
        return cuts

    def even(self, capacity: int, shards: int) -> list[int]:
        """Cuts within a feasible capacity that leave each shard near the mean of what remains.

        The greedy cuts leave all slack to the last shard. A cut may stand anywhere between the place from which the
        rest still fits (greedy from the end) and the place that greedy from here reaches.
        """
        least, at = [], self.total
        for _ in range(shards):
            least.append(at)
            at = int(self.ends[np.searchsorted(self.ends, max(0, at - capacity), side="left")])
        least, at, cuts = least[::-1], 0, []
        for k in range(shards):
            low = int(np.searchsorted(self.ends, max(at, least[k]), side="left"))
            high = int(np.searchsorted(self.ends, min(at + capacity, self.total), side="right")) - 1
            want = at + (self.total - at) / (shards - k)
            j = int(np.clip(np.searchsorted(self.ends, want), low, high))
            if j > low and want - self.ends[j - 1] < self.ends[j] - want:
                j -= 1
            at = int(self.ends[j])
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, place, least: int) -> int:
        low, high = least, max(least, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, place)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def _number(x: int) -> Column:
    return F.lit(Decimal(x)).cast("decimal(38,0)")


def _sums(groups: DataFrame, intervals: list[tuple[int, int]], per: int) -> list[tuple[int, int, int]]:
    """Blocks of equal width inside the intervals, with their first and last key that occur, and their sums."""
    block: Column | None = None
    for k, (low, high) in enumerate(intervals):
        width = max(1, -(-(high - low + 1) // per))
        index = F.call_function("div", F.col("at") - _number(low), _number(width)) + F.lit(k * per)
        test = F.col("at").between(_number(low), _number(high))
        block = F.when(test, index) if block is None else block.when(test, index)
    found = (
        groups.withColumn("_block", block)
        .filter(F.col("_block").isNotNull())
        .groupBy("_block")
        .agg(F.min("at").alias("low"), F.max("at").alias("high"), F.sum("bytes").alias("bytes"))
    )
    return sorted((int(r.low), int(r.high), int(r.bytes)) for r in found.collect())  # at most BLOCKS rows


def minimax_cuts(groups: DataFrame, shards: int, blocks: int = BLOCKS) -> tuple[int, list[int]]:
    """(smallest capacity, first key of each shard but the first) for groups with columns ``at`` (decimal) and ``bytes``."""
    ends = groups.agg(F.min("at"), F.max("at")).first()
    if ends[0] is None:
        return 0, []
    table = _sums(groups, [(int(ends[0]), int(ends[1]))], blocks)
    while True:
        b = Blocks(table)
        least = max([r[2] for r, a in zip(b.rows, b.atomic, strict=True) if a], default=1)
        low = b.smallest(shards, b.inside, least)
        high = b.smallest(shards, b.down, low)
        first, last = b.greedy(low, shards, b.down), b.greedy(high, shards, b.inside)
        active = np.zeros(len(table), dtype=bool)
        for x, y in zip(first, last, strict=True):
            active[np.searchsorted(b.ends, x, side="right") - 1 : np.searchsorted(b.ends, y, side="left")] = True
        big = np.array([r[2] > low for r in table]) & ~b.atomic  # may hide a group above the bound
        active = (active | big) & ~b.atomic
        if not active.any():
            break
        intervals: list[list[int]] = []  # first key, last key, first block, last block
        for k in np.flatnonzero(active):
            if intervals and intervals[-1][3] == k - 1:
                intervals[-1][1], intervals[-1][3] = table[k][1], k
            else:
                intervals.append([table[k][0], table[k][1], k, k])
        widest = max(y - x + 1 for _, _, x, y in intervals)
        finer = _sums(groups, [(x, y) for x, y, _, _ in intervals], max(2 * widest, blocks // len(intervals)))
        table = sorted([r for r, a in zip(table, active, strict=True) if not a] + finer)
    starts = {int(e): r[0] for e, r in zip(b.ends[:-1], b.rows, strict=True)}
    return high, [starts[c] for c in dict.fromkeys(b.even(high, shards)) if c < b.total]


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.unhex(F.md5(body)).alias("key"),
        ),
        "shard-rows",
    )
    last = rows.agg(F.max("doc_id")).first()[0]
    after = min((last if last is not None else 0) + 1, 2**63 - 1)
    first = F.coalesce(F.min("doc_id"), F.lit(after).cast("long")).cast("decimal(19,0)")
    # doc_id times 2 ** 60, and 60 bits of the digest: at most 38 digits
    digest = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("decimal(19,0)")
    at = (first * F.lit(Decimal(1 << 60)).cast("decimal(19,0)") + digest).cast("decimal(38,0)")
    groups = materialize(rows.groupBy("key").agg(at.alias("at"), F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    number = sum((F.when(F.col("at") >= _number(c), 1).otherwise(0) for c in cuts), F.lit(0))
    placed = rows.join(groups.select("key", number.alias("shard")), "key")
    return _slots(materialize(placed, "shard-placed"), shards)


def _slots(placed: DataFrame, shards: int) -> DataFrame:
    """Gapless slots: rows of a shard are dealt over counters by a hash of doc_id and text, counted, offset and numbered."""
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # one row a shard
    parts = [-(-counts.get(s, 0) // SLOT_ROWS) or 1 for s in range(shards)]
    part = F.pmod(F.xxhash64("doc_id", "key"), F.get(F.array(*map(F.lit, parts)), F.col("shard")).cast("long"))
    dealt = placed.withColumn("part", part)
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_last(), "key")
    numbered = dealt.withColumn("_rn", F.row_number().over(order))
    return numbered.join(small(offsets, sum(parts)), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("_rn") - 1).cast("long").alias("slot")
    )


def op9(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
