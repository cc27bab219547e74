"""Routing of records to subsystems by kind or header tag, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of each route, in the order in which routes are tried.
SYNC, CLAIM, MANIFEST, ACK, CHALLENGE, RESPONSE = 0x06, 0x30000002, 0x10000003, 0x2011, 0x40000002, 0x40000003
TASKS = (0x50000000, 0x5FFFFFFF)
PACKETS, TRUST = (0x08, 0x09), (0x0A, 0x0B)


def route(kind: Column, tag: Column) -> Column:
    """Manifests and acks count by kind only; all others by either."""
    return (
        F.when((kind == SYNC) | (tag == SYNC), "sync").when((kind == CLAIM) | (tag == CLAIM), "names")
        .when(kind.isin(CHALLENGE, RESPONSE, MANIFEST, ACK) | tag.isin(CHALLENGE, RESPONSE), "blobs")
        .when(kind.between(*TASKS) | tag.between(*TASKS), "tasks").when(kind.isin(*PACKETS) | tag.isin(*PACKETS), "packets")
        .when(kind.isin(*TRUST) | tag.isin(*TRUST), "trust").otherwise("store")
    )


def is_stored(routed: Column, handled: Column) -> Column:
    """Names and trust store what they accepted; blobs, tasks and the rest always; sync and packets never."""
    return F.when(routed.isin("names", "trust"), handled).otherwise(routed.isin("blobs", "tasks", "store"))


def dispatch(records: DataFrame, handled: Column | None = None) -> DataFrame:
    """records (kind, header_tag) with route and stored."""
    routed = records.withColumn("route", route(F.col("kind"), F.col("header_tag")))
    return routed.withColumn("stored", is_stored(F.col("route"), F.lit(True) if handled is None else handled))
