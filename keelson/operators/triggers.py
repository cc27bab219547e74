"""From triggers to tasks, from claims to leases, and other joins of subsystems."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.cron import Schedule
from keelson.functions.digests import _sha3
from keelson.functions.names import canonical_name, cron_task_id
from keelson.functions.time import lit
from keelson.sources.frames import claim_payload

from .leases import claim_problem
from .rules import fan_out

TASK = ["task_id", "worker_id", "payload", "timestamp"]


def cron_tasks(fired: DataFrame) -> DataFrame:
    """Of (job_id, trigger, worker_id, data)."""
    return fired.select(cron_task_id(F.col("job_id"), F.col("trigger")).alias("task_id"), "worker_id", F.col("data").alias("payload"), F.col("trigger").alias("timestamp"))


def record_tasks(records: DataFrame, routes: DataFrame, now: int | Column) -> DataFrame:
    """A task for each record (mask, target, record, timestamp, seq) and worker that its mask or target names."""
    hit = fan_out(records, routes)
    name = F.concat_ws("-", F.lit("env"), "worker_id", F.col("timestamp").cast("string"), F.col("seq").cast("string"))
    return hit.select(name.alias("task_id"), "worker_id", F.col("record").alias("payload"), lit(now).alias("timestamp"))


def manual_tasks(calls: DataFrame, now: int | Column) -> DataFrame:
    """Of (invocation_id or null, worker_id, data, seq)."""
    name = F.coalesce("invocation_id", F.concat_ws("-", F.lit("manual"), "worker_id", F.col("seq").cast("string")))
    return calls.select(name.alias("task_id"), "worker_id", F.col("data").alias("payload"), lit(now).alias("timestamp"))


def tasks(*parts: DataFrame) -> DataFrame:
    """One table of all tasks; a task that is there already isn't queued again."""
    out = parts[0].select(*TASK)
    for p in parts[1:]:
        out = out.unionByName(p.select(*TASK))
    return out.dropDuplicates(["task_id"])


def claims_to_leases(claims: DataFrame, now: int | Column, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Routing records of valid claims, and the other claims with the first rule that each breaks."""
    judged = claims.withColumn("problem", claim_problem(now, suffix))
    p = claim_payload(F.col("payload"))
    good = judged.where("problem is null").select(
        canonical_name(F.col("fqdn"), suffix).alias("fqdn"), F.col("sender_key").alias("owner"), p["peer"].alias("target"), p["addrs"].alias("addrs"), "expires_at",
        F.lit(False).alias("in_grace"), F.col("timestamp").alias("epoch"), p["key"].alias("key"),
    )
    return good, judged.where("problem is not null")


def route_modes(routes: DataFrame, events: DataFrame) -> DataFrame:
    """routes (peer, mode) after failures and recoveries (peer, seq, event): the last event tells."""
    last = events.groupBy("peer").agg(F.max_by("event", "seq").alias("event"))
    mode = F.when(F.col("event") == "failed", "Relay").when(F.col("event") == "recovered", "Direct").otherwise(F.col("mode"))
    return routes.join(last, "peer", "left").select("peer", mode.alias("mode"))


@dataclass
class Registry:
    """Workers by id: code digest, schedules and mask routes."""

    workers: dict[str, bytes] = field(default_factory=dict)
    jobs: list[tuple[str, str, int | None]] = field(default_factory=list)
    routes: list[tuple[int, str]] = field(default_factory=list)

    def register(self, worker_id: str, code: bytes, digest: bytes, schedules: list[str] = (), masks: list[int] = ()) -> None:
        """Refuses code that hasn't the stated digest, and schedules that can't be read."""
        if _sha3(code) != digest:
            raise ValueError("the code has another digest")
        for text in schedules:
            Schedule.parse(text)
        self.workers[worker_id] = code
        self.jobs += [(f"{worker_id}-{i}", text, None) for i, text in enumerate(schedules)]
        self.routes += [(mask, worker_id) for mask in masks if mask]
