"""Comparing and merging keyed replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retention import latest

MOST_NODES, MOST_KEYS, MOST_DEPTH = 64, 256, 16  # of one answer; fixed values


def diff(local: DataFrame, remote: DataFrame, keys: list[str], ts: str = "ts", tie: str = "envelope_id", tombstone: str = "is_tombstone") -> DataFrame:
    """keys and op: send what is only here or newer here, fetch the reverse. Equal (ts, tie) with one
    tombstone: the side that has it wins. One full outer join; keys are unique on both sides."""
    a, b = local.select(*keys, F.struct(ts, tie).alias("l"), F.col(tombstone).alias("lt")), remote.select(*keys, F.struct(ts, tie).alias("r"), F.col(tombstone).alias("rt"))
    op = (
        F.when(F.col("r").isNull() | (F.col("l") > F.col("r")), "send")
        .when(F.col("l").isNull() | (F.col("r") > F.col("l")), "fetch")
        .when(F.col("lt") & ~F.col("rt"), "send")
        .when(F.col("rt") & ~F.col("lt"), "fetch")
    )
    return a.join(b, keys, "full_outer").select(*keys, op.alias("op")).where(F.col("op").isNotNull())


def merge(local: DataFrame, remote: DataFrame, keys: list[str], ts: str = "ts", tie: str = "envelope_id") -> DataFrame:
    """Union under last write wins."""
    return latest(local.unionByName(remote), keys, ts, tie)


def checked_merge(local: DataFrame, remote: DataFrame, valid: Column, keys: list[str], ts: str = "ts", tie: str = "envelope_id") -> DataFrame:
    """merge, but one invalid remote row stops the whole batch."""
    if remote.where(~F.coalesce(valid, F.lit(False))).limit(1).count():
        raise ValueError("an entry of the batch is invalid")
    return merge(local, remote, keys, ts, tie)


def diff_from_root(local: DataFrame, local_root: bytes, remote_root: bytes, keys: list[str]) -> DataFrame:
    """keys and op where only the other side's root is known: nothing if the roots agree, else everything is sent."""
    return local.where(F.lit(local_root != remote_root)).select(*keys, F.lit("send").alias("op"))


def answer_nodes(nodes: DataFrame, records: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Records that a range request gets: of the nodes (node, depth, key, envelope_id; a row for each entry)
    down to MOST_DEPTH that hold any entry within [low, high], the first MOST_NODES in order, and of the
    distinct ids of all their entries the first MOST_KEYS. The caps are the feature."""
    inside = F.lit(True)
    for bound, test in ((low, lambda b: F.col("key") >= b), (high, lambda b: F.col("key") <= b)):
        inside = inside if bound is None else inside & test(bound)
    hit = nodes.where((F.col("depth") <= MOST_DEPTH) & inside).groupBy("node").agg(F.min("depth").alias("d"))
    taken = hit.orderBy("d", "node").limit(MOST_NODES).select("node")
    return answer(nodes.join(F.broadcast(taken), "node", "left_semi"), records)


def apply_counts(outcomes: DataFrame) -> DataFrame:
    """One row of counters of an applied batch, by the outcome of each entry."""
    count = lambda x: F.count(F.when(F.col("outcome") == x, 1))
    return outcomes.agg(F.count("*").alias("received"), count("Stored").alias("inserted"), count("Replaced").alias("updated"), count("SupersededLww").alias("superseded"))


def answer(index: DataFrame, records: DataFrame, low: Column | None = None, high: Column | None = None, most: int = MOST_KEYS) -> DataFrame:
    """Records of the distinct ids of index rows within [low, high], in id order, as far as the cap (which is the feature)."""
    for bound, test in ((low, F.col("key") >= low if low is not None else None), (high, F.col("key") <= high if high is not None else None)):
        index = index.where(test) if bound is not None else index
    ids = index.select(F.col("envelope_id").alias("id")).distinct().orderBy("id").limit(most)
    return records.join(F.broadcast(ids), "id")


def set_diff(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to send and to fetch where only presence counts."""
    return local.exceptAll(remote), remote.exceptAll(local)


def lookup(index: DataFrame, records: DataFrame) -> DataFrame:
    """Index rows with their records; null where the record is missing."""
    return index.join(records.withColumnRenamed("id", "envelope_id"), "envelope_id", "left")
