"""Consensus time, monotone sequences and replay in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_offsets(samples: DataFrame, order: str = "seq") -> DataFrame:
    return samples.groupBy("peer_id").agg(F.max_by("offset", order).alias("offset"))


def median_offset(offsets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """median_offset, truncated toward zero for an even number; 0 for none.

    Two order statistics come from exact percentiles, which merge counts of distinct values and never
    collect a group's rows.
    """
    low = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY offset)")
    high = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY offset DESC)")
    grouped = offsets.groupBy(*(by or [])).agg(low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"))
    return grouped.select(*(by or []), F.coalesce(F.expr("(lo + hi) div 2"), F.lit(0).cast("bigint")).alias("median_offset"))


def accepted(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """rows with accepted: value above all before it; while nothing but zeros came, any value is."""
    before = F.max(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("accepted", (F.coalesce(before, F.lit(0)) == 0) | (F.col(value) > before))


def epochs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The greatest epoch of each key, which is all that monotone updates leave."""
    return rows.groupBy(key).agg(F.max(value).alias(value))


def replay_batch(rows: DataFrame, key: str = "id", epoch: str = "epoch", order: str = "seq") -> DataFrame:
    """rows with accepted: not seen before in the same or the previous generation, where every
    arrival, accepted or not, is only remembered if it was accepted.

    Within an epoch the first arrival is the only one that can be; and over a run of neighbouring
    epochs acceptance alternates, so the parity of the place in the run decides.
    """
    first = F.row_number().over(W.partitionBy(key, epoch).orderBy(order)) == 1
    marked = rows.withColumn("__first", first)
    heads = marked.where("__first").select(key, epoch)
    w = W.partitionBy(key).orderBy(epoch)
    runs = heads.withColumn("__start", (F.col(epoch) - F.coalesce(F.lag(epoch).over(w), F.col(epoch) - 2) > 1).cast("int"))
    runs = runs.withColumn("__run", F.sum("__start").over(w))
    placed = runs.withColumn("__place", F.row_number().over(W.partitionBy(key, "__run").orderBy(epoch)))
    fresh = placed.select(key, epoch, (F.col("__place") % 2 == 1).alias("__fresh"))
    return marked.join(fresh, [key, epoch]).withColumn("accepted", F.col("__first") & F.col("__fresh")).drop("__first", "__fresh")


def lamport(tasks: DataFrame, order: str = "seq") -> DataFrame:
    """tasks with clock: a given one raises the counter to it, 0 takes the next.

    With n zeros up to a row, the counter is n plus the greatest of (given - zeros before it), so a
    running maximum replaces the sequential fold. One counter serves one queue.
    """
    w = W.partitionBy("queue").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    zeros = F.sum((F.col("lamport") == 0).cast("bigint")).over(w)
    raised = F.max(F.when(F.col("lamport") > 0, F.col("lamport") - F.col("__zeros"))).over(w)
    return tasks.withColumn("__zeros", zeros).withColumn("__raised", raised).withColumn(
        "clock", F.when(F.col("lamport") > 0, F.col("lamport")).otherwise(F.col("__zeros") + F.greatest(F.coalesce("__raised", F.lit(0)), F.lit(0)))
    ).drop("__zeros", "__raised")
