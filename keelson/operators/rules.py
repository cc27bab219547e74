"""Ordered first-match rules, routes and fan-out by bit mask. Rule and route tables are small by
nature; they are broadcast only up to a checked number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 10_000


def small(table: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """Broadcast if it is proven small; else left to the planner."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def protocol_matches(rule: Column, number: Column) -> Column:
    return (rule == "Any") | (rule == "Tcp") & (number == 6) | (rule == "Udp") & (number == 17) | (rule == "Icmp") & number.isin(1, 58)


def first_match(packets: DataFrame, rules: DataFrame, key: str, source: Column) -> DataFrame:
    """packets with rule_action: the action of the lowest rule_no that fits, null if none does.

    packets: key (unique), proto, dst_port (proto null: unreadable headers match no rule).
    rules: rule_no, source (null: any), protocol, dst_port (null: any), action.
    """
    r = small(rules.select(*[F.col(c).alias(f"r_{c}") for c in ("rule_no", "source", "protocol", "dst_port", "action")]))
    fits = (
        (F.col("r_source").isNull() | (F.col("r_source") == source)) & protocol_matches(F.col("r_protocol"), F.col("proto"))
        & (F.col("r_dst_port").isNull() | (F.col("r_dst_port") == F.col("dst_port")))
    )
    hits = packets.join(r, fits).groupBy(key).agg(F.min_by("r_action", "r_rule_no").alias("rule_action"))
    return packets.join(hits, key, "left")


def ingress(packets: DataFrame, peers: DataFrame, rules: DataFrame, local_owner: Column, key: str = "packet_id") -> DataFrame:
    """packets with verdict and reason: known peer, current epoch, first rule, else same owner."""
    known = packets.join(peers.select(F.col("id").alias("peer"), F.col("owner").alias("p_owner"), F.col("epoch").alias("p_epoch")), "peer", "left")
    found = first_match(known, rules, key, F.col("peer"))
    reason = (
        F.when(F.col("p_owner").isNull(), "unknown peer").when(F.col("epoch") < F.col("p_epoch"), "revoked epoch")
        .when(F.col("rule_action").isNotNull(), "rule").when(F.col("p_owner") == local_owner, "same owner").otherwise("quarantine")
    )
    allow = ((reason == "rule") & (F.col("rule_action") == "Allow")) | (reason == "same owner")
    return found.select(*packets.columns, F.when(allow, "Allow").otherwise("Deny").alias("verdict"), reason.alias("reason"))


def egress(packets: DataFrame, peers: DataFrame, rules: DataFrame, local_id: Column, local_owner: Column, key: str = "packet_id") -> DataFrame:
    """As ingress, but rules speak of the local node and no epoch counts."""
    known = packets.join(peers.select(F.col("id").alias("peer"), F.col("owner").alias("p_owner")), "peer", "left")
    found = first_match(known, rules, key, local_id)
    reason = (
        F.when(F.col("p_owner").isNull(), "unknown peer").when(F.col("rule_action").isNotNull(), "rule")
        .when(F.col("p_owner") == local_owner, "same owner").otherwise("quarantine")
    )
    allow = ((reason == "rule") & (F.col("rule_action") == "Allow")) | (reason == "same owner")
    return found.select(*packets.columns, F.when(allow, "Allow").otherwise("Deny").alias("verdict"), reason.alias("reason"))


def counters(judged: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    return judged.agg(
        count(F.col("verdict") == "Allow").alias("allowed"), count(F.col("verdict") == "Deny").alias("denied"),
        count(F.col("reason").isin("unknown peer", "quarantine")).alias("quarantined"), count(F.col("reason") == "revoked epoch").alias("revoked"),
    )


def outbound(packets: DataFrame, sessions: DataFrame, routes: DataFrame, relays: DataFrame) -> DataFrame:
    """packets with route: direct where the peer's route says so, else the relay of least id, else Fallback; Dropped without a session or verdict."""
    relay = relays.agg(F.min("relay_id").alias("relay_id"))
    found = packets.join(sessions.select(F.col("peer"), F.lit(True).alias("in_session")), "peer", "left").join(routes.select("peer", "mode"), "peer", "left").crossJoin(F.broadcast(relay))
    route = (
        F.when(F.col("in_session").isNull() | (F.col("verdict") != "Allow"), "Dropped").when(F.coalesce("mode", F.lit("Direct")) == "Direct", "Direct")
        .when(F.col("relay_id").isNotNull(), F.concat(F.lit("Relay:"), F.col("relay_id").cast("string"))).otherwise("Fallback")
    )
    return found.select(*packets.columns, route.alias("route"))


def fan_out(records: DataFrame, routes: DataFrame, mask: str = "mask") -> DataFrame:
    """A row for each record and worker whose route mask meets the record's; an explicit target stands alone."""
    r = small(routes.select(F.col("mask").alias("route_mask"), "worker_id"))
    direct = records.where(F.col("target").isNotNull()).withColumn("worker_id", F.col("target"))
    by_mask = records.where(F.col("target").isNull()).join(r, F.col(mask).bitwiseAND(F.col("route_mask")) != 0).drop("route_mask")
    return direct.unionByName(by_mask)


def forward(records: DataFrame, clients: DataFrame) -> DataFrame:
    """records with endpoint and forwarded (false: no such recipient)."""
    return records.join(clients.select(F.col("id").alias("recipient"), "endpoint"), "recipient", "left").withColumn("forwarded", F.col("endpoint").isNotNull())
