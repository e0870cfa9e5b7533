"""Minimax sharding: ordered atomic groups are cut into contiguous shards whose largest is as small as can be.

Groups are equal texts, ordered by their first ``doc_id``. A running total gives each group its start in bytes, so a
shard is a byte range between two group boundaries, and the smallest capacity for which a greedy walk needs no more
than the wanted shards is found by binary search.

The walk runs on the driver over a bounded picture of the boundaries: at most ``BLOCKS`` intervals, each known to hold
one group (closed) or several (open). A walk on open intervals yields a lower and an upper bound for every cut; what
they leave undecided is a narrow byte range around each cut, and only the groups in these are asked for in more
detail, until the capacity and the cuts are exact. The groups themselves never leave the executors.

Of all partitions with that capacity the one whose cuts lie nearest to equal shares is taken; a plain greedy cut would
leave the last shard nearly empty.

Defined cases: a null text counts as the empty one (size 1, the same group); null ids come last within a shard;
repeated rows are one group and get a slot each; an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import table, text_of
from cairn.llm.registry import query
from cairn.operators.ordering import positions, running_total
from cairn.session import cut

SHARDS = 16
#: Intervals the driver holds at most, whatever the number of groups.
BLOCKS = 8192


def sized(docs: DataFrame) -> DataFrame:
    """The narrow table all else works on: doc_id, size, text_crc32, key of the text, a number for the row."""
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


class Boundaries:
    """Group boundaries as known so far: ``at[i]`` is one, ``open[i]`` says whether more lie before ``at[i + 1]``."""

    def __init__(self, groups: DataFrame, total: int):
        self.groups, self.total = groups, total
        self.at, self.open, self.width = [0, total], [True], [2 * total]
        self.refine([(0, total)])

    def refine(self, zones: list[tuple[int, int]]) -> None:
        """Look closer at zones, each from one known boundary to another; they don't overlap."""
        each = max(2, BLOCKS // len(zones))
        zone = start = None
        widths: list[int] = []
        for i, (low, high) in enumerate(zones):
            inside = (F.col("start") >= low) & (F.col("start") < high)
            # Half as wide as the last time at most, so that every look closer ends.
            width = max(1, min(-(-(high - low) // each), min(w for a, w in zip(self.at, self.width) if low <= a < high) // 2))
            widths.append(width)
            number = F.floor((F.col("start") - low) / F.lit(width))
            zone = F.when(inside, i) if zone is None else zone.when(inside, i)
            start = F.when(inside, number) if start is None else start.when(inside, number)
        blocks = (
            self.groups.select(zone.alias("zone"), start.alias("block"), "start").where("zone IS NOT NULL")
            .groupBy("zone", "block").agg(F.min("start").alias("first"), F.count(F.lit(1)).alias("n")).collect()
        )
        found = {b["first"]: (b["n"] > 1, widths[b["zone"]]) for b in blocks}
        for a, o, w in zip(self.at[:-1], self.open, self.width, strict=True):
            if not any(low <= a < high for low, high in zones):
                found[a] = o, w
        self.at = [*sorted(found), self.total]
        self.open, self.width = [found[a][0] for a in self.at[:-1]], [found[a][1] for a in self.at[:-1]]

    def interval(self, x: int) -> int:
        return min(bisect_right(self.at, x) - 1, len(self.open) - 1)

    def floor(self, x: int, surely: bool) -> int:
        """The last boundary up to ``x``; if that isn't known, a boundary before it (surely) or ``x`` itself."""
        if x >= self.total:
            return self.total
        i = self.interval(x)
        return x if self.open[i] and not surely else self.at[i]

    def walk(self, capacity: int, shards: int, surely: bool) -> list[int]:
        cuts = [0]
        for _ in range(shards):
            cuts.append(self.floor(cuts[-1] + capacity, surely))
        return cuts


def _least(low: int, high: int, holds) -> int:
    """The least of low..high for which ``holds``, which is then true for all above; high is not asked."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


def _capacity(b: Boundaries, shards: int, largest: int) -> int:
    """The smallest capacity with which the greedy walk needs at most ``shards`` shards."""
    low, high = max(largest, -(-b.total // shards)), largest + -(-b.total // shards)
    while True:
        high = _least(low, high, lambda c: b.walk(c, shards, True)[-1] >= b.total)
        low = _least(low, high, lambda c: b.walk(c, shards, False)[-1] >= b.total)
        if low == high:
            return high
        zones = _zones(b, zip(b.walk(low, shards, True), b.walk(high, shards, False), strict=True))
        if not zones:
            return high
        b.refine(zones)


def _zones(b: Boundaries, ranges) -> list[tuple[int, int]]:
    """The open intervals that meet the ranges, neighbours joined."""
    hit = sorted({i for low, high in ranges if low < b.total
                  for i in range(b.interval(low), b.interval(min(high, b.total - 1)) + 1) if b.open[i]})
    zones: list[tuple[int, int]] = []
    for i in hit:
        if zones and zones[-1][1] == b.at[i]:
            zones[-1] = (zones[-1][0], b.at[i + 1])
        else:
            zones.append((b.at[i], b.at[i + 1]))
    return zones


def _even_cuts(b: Boundaries, shards: int, capacity: int) -> list[int]:
    """Cuts within ``capacity``, each as near to its equal share as those before and the rest allow."""
    while True:
        asked: set[int] = set()

        def near(x: int) -> tuple[int, int]:
            """Boundaries at or before and at or after x, as known so far."""
            if x >= b.total:
                return b.total, b.total
            i = b.interval(x)
            if b.open[i] and b.at[i] != x:
                asked.add(i)
            return b.at[i], b.at[i] if b.at[i] == x else b.at[i + 1]

        latest = [b.total]  # from the right: the least place where each shard may start
        for _ in range(shards - 1):
            latest.append(near(max(0, latest[-1] - capacity))[1])
        latest.reverse()
        cuts = [0]
        for j in range(1, shards):
            ideal = j * b.total // shards
            before, after = near(ideal)
            best = before if ideal - before <= after - ideal else after
            cuts.append(max(cuts[-1], latest[j - 1], min(best, near(cuts[-1] + capacity)[0])))
        if not asked:
            return cuts[1:]
        b.refine([(b.at[i], b.at[i + 1]) for i in sorted(asked)])


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Starts of shards 1 and on, in bytes. ``groups`` has ``start`` and ``bytes``; its starts have no gaps."""
    whole = groups.agg(F.max(F.col("start") + F.col("bytes")).alias("total"), F.max("bytes").alias("largest")).first()
    if whole["total"] is None or shards < 2:
        return []
    b = Boundaries(groups, whole["total"])
    return _even_cuts(b, shards, _capacity(b, shards, whole["largest"]))


def minimax_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard, in order of doc_id)."""
    rows = cut(sized(docs))
    grouped = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first"))
    starts = cut(running_total(grouped, [], ["first", "key"], "bytes", "end").select(
        "key", "bytes", (F.col("end") - F.col("bytes")).alias("start")))
    cuts = F.array(*[F.lit(c).cast("long") for c in minimax_cuts(starts, shards)]).cast("array<long>")
    dealt = starts.select("key", F.size(F.filter(cuts, lambda c: c <= F.col("start"))).cast("int").alias("shard"))
    placed = rows.join(dealt, "key").withColumn("nulls", F.col("doc_id").isNull())
    slots = positions(placed, ["shard"], ["nulls", "doc_id", "row"], "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))


@query("op9_minimax_shards")
def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minimax_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
