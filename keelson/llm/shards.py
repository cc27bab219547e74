"""Operator 10: minimax contiguous partition of ordered atomic groups into shards.

Groups of equal texts stay whole and are ordered by their smallest id. The smallest capacity for
which greedy cutting needs no more than the given number of shards is found by binary search, and
the groups are cut there. Groups are never collected: the driver holds sums of blocks of
neighbouring groups, of a fixed number. Cutting by block boundaries bounds each cut from both
sides; only blocks that a cut may fall in are opened, level by level, until no cut is open.

Edge cases: a null text has size 1 and is not equal to an empty text; null ids sort first;
repeated rows are of one group; with fewer groups than shards some shards stay empty; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

BLOCKS = 1 << 14  # entries that the driver holds at a level


@dataclass
class Run:
    """Neighbouring groups from offset lo to hi, the last of which starts at last."""

    lo: int
    hi: int
    last: int

    @property
    def atomic(self) -> bool:
        return self.lo == self.last


def bounded_cuts(runs: list[Run], capacity: int, upper: bool, shards: int) -> list[int]:
    """Greedy cut offsets. upper: no true cut lies beyond; else none lies before. Stops past the shards."""
    ends = np.array([r.hi for r in runs], dtype=np.int64)
    total, at, cuts = int(ends[-1]), 0, []
    while at < total and len(cuts) <= shards:
        reach = at + capacity
        i = int(np.searchsorted(ends, reach, side="right"))
        if i == len(runs):
            at = total
        else:
            at = reach if upper and not runs[i].atomic else runs[i].lo
        cuts.append(at)
    return cuts


def feasible(runs: list[Run], capacity: int, shards: int, upper: bool) -> bool:
    cuts = bounded_cuts(runs, capacity, upper, shards)
    return len(cuts) <= shards and cuts[-1] >= runs[-1].hi


def bracket(runs: list[Run], largest: int, shards: int) -> tuple[int, int]:
    """Lowest capacity that may do, lowest that surely does."""
    total = runs[-1].hi
    floor = max(largest, -(-total // shards))

    def lowest(upper: bool) -> int:
        lo, hi = floor, floor + largest + max((r.hi - r.lo for r in runs), default=0)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if feasible(runs, mid, shards, upper) else (mid + 1, hi)
        return lo

    return lowest(True), lowest(False)


def split(groups: DataFrame, shards: int) -> list[int]:
    """Ascending cut offsets (the last is the total) over groups (at, size): at is the offset of a group."""
    edge = groups.agg(F.max(F.col("at") + F.col("size")).alias("total"), F.max("size").alias("largest")).first()
    if edge["total"] is None:
        return []
    total, largest = int(edge["total"]), int(edge["largest"])

    def opened(parts: list[tuple[int, int, int]]) -> list[Run]:
        """Runs of groups that start in each (lo, hi), parted every step bytes."""
        cond = F.lit(None).cast("bigint")
        for lo, hi, step in parts:
            cond = F.when((F.col("at") >= lo) & (F.col("at") < hi), F.lit(lo) + F.floor((F.col("at") - lo) / F.lit(step)) * step).otherwise(cond)
        found = groups.withColumn("part", cond).where(F.col("part").isNotNull()).groupBy("part").agg(
            F.min("at").alias("lo"), F.max(F.col("at") + F.col("size")).alias("hi"), F.max("at").alias("last"))
        return sorted((Run(r["lo"], r["hi"], r["last"]) for r in found.collect()), key=lambda r: r.lo)

    runs = opened([(0, total, max(1, -(-total // BLOCKS)))])
    while True:
        low, high = bracket(runs, largest, shards)
        first = bounded_cuts(runs, low, False, shards)
        last = bounded_cuts(runs, high, True, shards)
        regions = open_regions(runs, first, last + [total] * (len(first) - len(last)))
        if not regions:
            return first
        finer = opened([(runs[i].lo, runs[j].last + 1, finer_step(runs[i : j + 1], BLOCKS // len(regions))) for i, j in regions])
        for i, j in reversed(regions):
            runs[i : j + 1] = [r for r in finer if runs[i].lo <= r.lo < runs[j].hi]


def finer_step(region: list[Run], parts: int) -> int:
    """Small enough for parts cells, and at most half the widest run, so that every level parts it."""
    width, widest = region[-1].last + 1 - region[0].lo, max(r.last - r.lo for r in region)
    return max(1, min(-(-width // max(1, parts)), widest // 2))


def open_regions(runs: list[Run], first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Index ranges of runs in which a cut may fall and that hold a run of several groups."""
    spans: list[tuple[int, int]] = []
    for a, b in zip(first, last, strict=False):
        inside = [k for k, r in enumerate(runs) if r.lo < b and r.hi > a and not r.atomic] if a < b else []
        if inside and spans and inside[0] <= spans[-1][1] + 1:
            spans[-1] = spans[-1][0], max(spans[-1][1], inside[-1])
        elif inside:
            spans.append((inside[0], inside[-1]))
    return spans


def assign(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard by the law `bytes`.

    Texts are digested where they are read (SHA-256 stands for the text) and never shuffled. Rows
    are put in order (group, id) by ranges, so a large group spreads over many tasks; places within
    a range come from the stored order and sums of ranges from the driver, one for each range.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    text = F.col(text_col)
    docs = materialize(
        df.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("sha"),
        ),
        "sizes",
    )
    sums = docs.groupBy("sha").agg(F.min("doc_id").alias("gid"), F.sum("size").alias("gsize"))
    placed = docs.join(sums.select("sha", "gid"), "sha")
    keys = [F.col("gid").asc_nulls_first(), F.col("sha"), F.col("doc_id").asc_nulls_first()]
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    lane, row = F.shiftright("mid", 33).cast("int").alias("lane"), F.col("mid").bitwiseAND((1 << 33) - 1).alias("row")
    rows = materialize(ordered.withColumn("mid", F.monotonically_increasing_id()).select("doc_id", "size", "text_crc32", "sha", "gid", lane, row), "ordered-rows")
    by_group = sums.select("gid", "sha", F.col("gsize").alias("size")).repartitionByRange(parts, *keys[:2]).sortWithinPartitions(*keys[:2])
    groups = materialize(by_group.withColumn("mid", F.monotonically_increasing_id()).select("gid", "sha", "size", lane, row), "ordered-groups")

    def starts(table: DataFrame, value: F.Column) -> F.Column:
        """What stands before each lane, as an expression over the column lane."""
        found = sorted((r["lane"], r["n"]) for r in table.groupBy("lane").agg(value.alias("n")).collect())
        before, total = [], 0
        for k, n in found:
            before += [F.lit(k), F.lit(total).cast("bigint")]
            total += n
        return F.element_at(F.create_map(*before), F.col("lane")) if before else F.lit(0).cast("bigint")

    from pyspark.sql import Window as W

    inside = F.sum("size").over(W.partitionBy("lane").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    offsets = materialize(
        groups.withColumn("at", starts(groups, F.sum("size")) + F.coalesce(inside, F.lit(0))).select("sha", "size", "at"), "offsets"
    )
    cuts = split(offsets, shards)
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (F.col("at") >= F.lit(cut)).cast("int")
    where = offsets.select("sha", shard.alias("shard"))
    numbered = rows.withColumn("place", starts(rows, F.count("*")) + F.col("row"))
    sharded = numbered.join(where, "sha")
    first = {r["shard"]: r["p"] for r in sharded.groupBy("shard").agg(F.min("place").alias("p")).collect()}
    base = F.element_at(F.create_map(*[x for k, p in first.items() for x in (F.lit(k), F.lit(p))]), F.col("shard")) if first else F.lit(0)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - base).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
