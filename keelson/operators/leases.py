"""Name leases: validation of claims, registration and renewal, three-tier lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.names import canonical_name, name_problem
from keelson.functions.time import GRACE, LONGEST_LEASE, lease_length_ok, lease_state, lit

CLAIM_KIND = 0x30000002  # fixed value


def claim_problem(now: int | Column, suffix: str, need_signature: bool = True) -> Column:
    """The first rule that a claim breaks, in order; null if none. Escrow is a verdict column."""
    broken = (
        F.when(~F.col("magic_ok"), "magic").when(~F.col("header_ok"), "header").when(F.col("kind") != CLAIM_KIND, "kind")
        .when(F.col("fqdn").isNull() | F.col("nonce").isNull() | F.col("expires_at").isNull() | F.col("contract").isNull(), "tags")
        .when(name_problem(F.col("fqdn"), suffix).isNotNull(), "name").when(F.substring("pow_hash", 1, 2) != F.unhex(F.lit("0000")), "proof of work")
        .when(~lease_length_ok(F.col("expires_at"), now), "lease").when(~F.coalesce("escrow_ok", F.lit(False)), "escrow")
    )
    return broken.when(~F.col("sig_ok"), "signature") if need_signature else broken


def escrowed(claims: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """claims with escrow_ok by an allow-list of contracts; without a list all are allowed."""
    if allowed is None:
        return claims.withColumn("escrow_ok", F.lit(True))
    listed = allowed.select("contract").distinct().withColumn("escrow_ok", F.lit(True))
    return claims.join(listed, "contract", "left").withColumn("escrow_ok", F.coalesce("escrow_ok", F.lit(False)))


def states(records: DataFrame, now: int | Column) -> DataFrame:
    return records.withColumn("state", lease_state(F.col("expires_at"), now))


def step(existing: DataFrame, requests: DataFrame, now: int | Column, suffix: str) -> DataFrame:
    """requests (op, fqdn, owner, expires_at; one for each name) with the outcome against existing."""
    r = requests.withColumn("name", canonical_name(F.col("fqdn"), suffix))
    old = existing.select(F.col("fqdn").alias("name"), F.col("owner").alias("old_owner"), lease_state(F.col("expires_at"), now).alias("old_state"))
    own, state = F.col("old_owner") == F.col("owner"), F.col("old_state")
    register = F.when(state == "Active", "AlreadyActive").when((state == "Grace") & ~own, "GraceUnauthorized").otherwise("Ok")
    renew = (
        F.when(state.isNull(), "NotRegistered").when(state == "Expired", "Expired").when((state == "Active") & ~own, "Unauthorized")
        .when(~own, "GraceUnauthorized").otherwise("Ok")
    )
    outcome = (
        F.when(F.col("name").isNull(), "BadName").when(~lease_length_ok(F.col("expires_at"), now), "BadLease")
        .when(F.col("op") == "register", register).otherwise(renew)
    )
    return r.join(old, "name", "left").select(*requests.columns, outcome.alias("outcome"))


def fold(requests: DataFrame, suffix: str) -> DataFrame:
    """fqdn, seq, outcome of requests (op, fqdn, owner, expires_at, at, seq) replayed in order of seq.

    Each name's requests stream through one task in order; only the present lease is held.
    """
    ready = requests.withColumn("name", canonical_name(F.col("fqdn"), suffix)).select("name", "fqdn", "seq", "op", "owner", "expires_at", "at")

    def outcome(held: tuple | None, op: str, owner: object, expires: int, now: int) -> str:
        if not now < expires <= now + LONGEST_LEASE:
            return "BadLease"
        state = None if held is None else "Active" if now <= held[1] else "Grace" if now <= held[1] + GRACE else "Expired"
        own = held is not None and held[0] == owner
        if op == "register":
            return "AlreadyActive" if state == "Active" else "GraceUnauthorized" if state == "Grace" and not own else "Ok"
        if state is None:
            return "NotRegistered"
        return "Expired" if state == "Expired" else "Ok" if own else "Unauthorized" if state == "Active" else "GraceUnauthorized"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for rows in batches:
            out = []
            for name, fqdn, seq, op, owner, expires, at in rows.itertuples(index=False):
                if name != now:
                    now, held = name, None
                found = outcome(held, op, owner, expires, at) if name is not None else "BadName"
                if found == "Ok":
                    held = owner, expires
                out.append((fqdn, seq, found))
            yield pd.DataFrame(out, columns=["fqdn", "seq", "outcome"])

    return ready.repartition(F.col("name")).sortWithinPartitions("name", "seq").mapInPandas(run, "fqdn string, seq bigint, outcome string")


def evicted(records: DataFrame, now: int | Column) -> DataFrame:
    """What an eviction leaves."""
    return records.where(lease_state(F.col("expires_at"), now) != "Expired")


def resolve(queries: DataFrame, derived: DataFrame, overlays: DataFrame, public: DataFrame, now: int | Column) -> DataFrame:
    """queries (caller, fqdn) with target, tier and in_grace: a derived name, else the caller's overlay, else the public record that hasn't expired."""
    name = F.lower("fqdn")
    q = queries.withColumn("name", name)
    d = derived.select(F.lower("fqdn").alias("name"), F.col("target").alias("d_target"))
    o = overlays.select(F.col("owner").alias("caller"), F.lower("domain").alias("name"), F.col("target").alias("o_target"))
    p = public.where(lease_state(F.col("expires_at"), now) != "Expired").select(F.lower("fqdn").alias("name"), F.col("target").alias("p_target"), (lit(now) > F.col("expires_at")).alias("p_grace"))
    found = q.join(d, "name", "left").join(o, ["caller", "name"], "left").join(p, "name", "left")
    tier = F.when(F.col("d_target").isNotNull(), "derived").when(F.col("o_target").isNotNull(), "overlay").when(F.col("p_target").isNotNull(), "public")
    return found.select(*queries.columns, F.coalesce("d_target", "o_target", "p_target").alias("target"), tier.alias("tier"), F.when(tier == "public", F.col("p_grace")).alias("in_grace"))


def response_code(is_response: Column, opcode: Column, questions: Column, in_namespace: Column, in_grace: Column, hit: Column, failed: Column, upstream: Column) -> Column:
    """Decision of a resolver; null: dropped."""
    inside = F.when(failed, "SERVFAIL").when(in_grace, "NXDOMAIN").when(hit, "NOERROR").otherwise("NXDOMAIN")
    return (
        F.when(is_response, None).when(opcode != 0, "NOTIMP").when(questions == 0, "FORMERR").when(in_namespace, inside)
        .when(upstream, "FORWARD").otherwise("REFUSED")
    )
