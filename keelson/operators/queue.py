"""Leased tasks, dead letters and scheduled jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.cron import Schedule, latest_trigger
from keelson.functions.names import cron_task_id
from keelson.functions.time import lit, sweep_due

MOST_ATTEMPTS = 3  # fixed value


def newest(tasks: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each task: greatest clock; of equal clocks the first arrival stays."""
    rest = [c for c in tasks.columns if c != "id"]
    return tasks.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(F.col("lamport"), -F.col(order))).alias("t")).select("id", "t.*").select(*tasks.columns)


def sweep(leases: DataFrame, now: int | Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """leases with status after a sweep: due ones go back to Pending, or to DeadLetter once all attempts are used."""
    due = sweep_due(F.col("granted_at"), F.col("duration"), F.col("acked"), now)
    status = F.when(due & (F.col("attempts") >= most), "DeadLetter").when(due, "Pending").when(F.col("acked"), "Completed").otherwise("Running")
    return leases.withColumn("status", status)


def counts(tasks: DataFrame) -> DataFrame:
    """One row: tasks by state, and writes to disk (all but those that completed in memory)."""
    count = lambda x: F.count(F.when(F.col("status") == x, 1))
    return tasks.agg(F.count("*").alias("tasks"), count("Running").alias("active_leases"), count("Completed").alias("completed"), count("DeadLetter").alias("dead"), F.count(F.when(F.col("status") != "Completed", 1)).alias("disk_writes"))


def dead_letters(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") == "DeadLetter")


def rehydrated(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin("Pending", "Running")).orderBy("lamport", "id")


def next_ready(tasks: DataFrame) -> DataFrame:
    """The one task that a dispatch takes."""
    return tasks.where(~F.col("status").isin("Completed", "DeadLetter")).orderBy("ready_seq").limit(1)


def current(ids: DataFrame, completed: DataFrame, leased: DataFrame, durable: DataFrame) -> DataFrame:
    """id, task: from completed ones in memory, else active leases, else the store."""
    found = ids.select("id")
    for i, source in enumerate((completed, leased, durable)):
        found = found.join(source.select("id", F.col("task").alias(f"t{i}")), "id", "left")
    return found.select("id", F.coalesce("t0", "t1", "t2").alias("task"))


def folded(events: DataFrame) -> DataFrame:
    """id, status, attempts of each task after all its events (id, seq, event), by aggregates:
    completed if any completion follows; else the last event tells."""
    last = F.max_by("event", "seq")
    done = F.max(F.when(F.col("event") == "complete", F.col("seq")))
    tries = F.count(F.when(F.col("event") == "dispatch", 1))
    out = events.groupBy("id").agg(last.alias("last"), done.alias("done"), tries.cast("int").alias("attempts"))
    status = (
        F.when(F.col("done").isNotNull(), "Completed").when((F.col("last") == "expire") & (F.col("attempts") >= MOST_ATTEMPTS), "DeadLetter")
        .when(F.col("last") == "dispatch", "Running").otherwise("Pending")
    )
    return out.select("id", status.alias("status"), "attempts")


def jobs(spark, rows: list[tuple[str, str, int | None]]) -> DataFrame:
    """id, masks and cursor of (id, schedule text, last run or None)."""
    data = [(i, *Schedule.parse(text).masks, last) for i, text, last in rows]
    return spark.createDataFrame(data, "id string, m0 bigint, m1 bigint, m2 bigint, m3 bigint, m4 bigint, last_run bigint")


def tick(table: DataFrame, now: int | Column) -> DataFrame:
    """id, trigger (null: none), task_id, last_run: of missed minutes only the latest counts, and the cursor moves on in any case."""
    last = F.coalesce(F.col("last_run"), lit(now))
    trigger = latest_trigger(last, lit(now), [F.col(f"m{i}") for i in range(5)])
    return table.select("id", trigger.alias("trigger"), F.greatest(last, lit(now)).alias("last_run")).withColumn(
        "task_id", F.when(F.col("trigger").isNotNull(), cron_task_id(F.col("id"), F.col("trigger")))
    )
