"""Custody of stored blobs, eviction gates and session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.time import idle, lit

STAGED_FOR, LARGEST, KEEPERS, DATA, TOTAL = 72 * 3600, 25 << 20, 10, 10, 14  # fixed values


def staged(blobs: DataFrame, now: int | Column) -> DataFrame:
    """Custody records of blobs (blob_cid, size) below the limit."""
    return blobs.where(F.col("size") < LARGEST).select(
        "blob_cid", F.lit("Staged").alias("state"), lit(now).alias("staged_at"), (lit(now) + STAGED_FOR).alias("expires_at"), F.sequence(F.lit(0), F.lit(TOTAL - 1)).alias("shards")
    )


def acknowledged(records: DataFrame, acks: DataFrame) -> DataFrame:
    """records after acks (blob_cid), with outcome: Staged becomes Confirmed and keeps its parity shards."""
    hit = records.join(acks.select("blob_cid").distinct().withColumn("acked", F.lit(True)), "blob_cid", "left")
    acked, state = F.coalesce("acked", F.lit(False)), F.col("state")
    moved = acked & (state == "Staged")
    outcome = F.when(~acked, None).when(state.isin("Staged", "Confirmed"), "Confirmed").otherwise("Error")
    return hit.select(
        "blob_cid", F.when(moved, "Confirmed").otherwise(state).alias("state"), "staged_at", "expires_at",
        F.when(moved, F.sequence(F.lit(DATA), F.lit(TOTAL - 1))).otherwise(F.col("shards")).alias("shards"), outcome.alias("outcome"),
    )


def pruned(records: DataFrame, now: int | Column) -> DataFrame:
    """Staged records whose time is over expire and lose their data shards."""
    over = (F.col("state") == "Staged") & (lit(now) >= F.col("expires_at"))
    return records.withColumns({"state": F.when(over, "Expired").otherwise(F.col("state")), "shards": F.when(over, F.sequence(F.lit(DATA), F.lit(TOTAL - 1))).otherwise(F.col("shards"))})


def unlocked(keepers: DataFrame, acks: DataFrame, key: str = "blob_cid", keeper: str = "keeper") -> DataFrame:
    """key, n_keepers, unlocked: an ack, or ten distinct keepers."""
    n = keepers.groupBy(key).agg(F.countDistinct(keeper).alias("n_keepers"))
    found = n.join(acks.select(key).distinct().withColumn("acked", F.lit(True)), key, "full_outer")
    count = F.coalesce("n_keepers", F.lit(0).cast("bigint"))
    return found.select(key, count.alias("n_keepers"), (F.coalesce("acked", F.lit(False)) | (count >= KEEPERS)).alias("unlocked"))


def evict(blobs: DataFrame, gates: DataFrame, key: str = "blob_cid") -> DataFrame:
    """What an eviction takes: only unlocked blobs."""
    return blobs.join(gates.where("unlocked").select(key), key, "left_semi")


def sessions(inserts: DataFrame, order: str = "seq") -> DataFrame:
    """The table that inserts leave: a later one takes the place of any with its session id or its peer."""
    rest = [c for c in inserts.columns if c != "session_id"]
    by_id = inserts.groupBy("session_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("session_id", "r.*")
    newer = inserts.groupBy("peer").agg(F.max(order).alias("last"))
    return by_id.join(newer, "peer").where(F.col(order) == F.col("last")).select(*inserts.columns)


def active_sessions(table: DataFrame, now: int | Column, limit: int = 180) -> DataFrame:
    return table.where(~idle(F.col("last_seen"), now, limit))
