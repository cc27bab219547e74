"""Integer epochs in seconds. `now` is a parameter everywhere; nothing reads a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HALF_LIFE = 30 * 86400
GRACE = 14 * 86400
LONGEST_LEASE = 365 * 86400
DRIFT = 30


def lit(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def epoch(ts: Column) -> Column:
    """Seconds of a timestamp with or without a zone (UTC session)."""
    return F.unix_seconds(ts.cast("timestamp"))


def decayed(weight: Column, issued: Column, now: int | Column) -> Column:
    """Half-life decay; from the future or just issued: the weight as it is, else within [0, 1]."""
    age = lit(now) - issued
    faded = weight * F.pow(F.lit(2.0), -age.cast("double") / HALF_LIFE)
    return F.when(age <= 0, weight).otherwise(F.least(F.greatest(faded, F.lit(0.0)), F.lit(1.0)))


def within_drift(ts: Column, reference: int | Column, limit: int = DRIFT) -> Column:
    return F.abs(ts - lit(reference)) <= limit


def lease_state(expires: Column, now: int | Column) -> Column:
    return F.when(lit(now) <= expires, "Active").when(lit(now) <= expires + GRACE, "Grace").otherwise("Expired")


def lease_length_ok(expires: Column, now: int | Column) -> Column:
    return (expires > lit(now)) & (expires <= lit(now) + LONGEST_LEASE)


def network_time(local: int | Column, median: Column) -> Column:
    return F.greatest(lit(local) + median, F.lit(0).cast("bigint"))


def lease_elapsed(granted: Column, duration: Column, now: int | Column) -> Column:
    """Strictly more than the duration has passed."""
    return lit(now) - granted > duration


def sweep_due(granted: Column, duration: Column, acked: Column, now: int | Column) -> Column:
    """The queue's sweep takes leases from the duration on, unlike lease_elapsed."""
    return ~acked & (lit(now) - granted >= duration)


def remaining(granted: Column, duration: Column, now: int | Column) -> Column:
    return F.greatest(duration - (lit(now) - granted), F.lit(0).cast("bigint"))


def idle(last_seen: Column, now: int | Column, limit: int = 180) -> Column:
    return F.greatest(lit(now) - last_seen, F.lit(0).cast("bigint")) > limit


def civil(ts: Column) -> Column:
    """Struct of UTC fields; weekday 0 is Sunday."""
    t = F.timestamp_seconds(ts)
    return F.struct(
        F.minute(t).alias("minute"), F.hour(t).alias("hour"), F.dayofmonth(t).alias("day"), F.month(t).alias("month"), (F.dayofweek(t) - 1).alias("weekday")
    )
