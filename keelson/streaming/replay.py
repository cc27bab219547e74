"""Replay suppression and sessions over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keelson.functions.time import DRIFT, within_drift


def deduplicated(stream: DataFrame, key: str = "id", ts: str = "ts", memory: str = "2 hours") -> DataFrame:
    """The first arrival of each id within the time that two generations are remembered; exact, so
    without false alarms of a filter. State is dropped behind the watermark."""
    return stream.withWatermark(ts, memory).dropDuplicatesWithinWatermark([key])


def gated(stream: DataFrame, ts: str = "ts_seconds", reference: str = "consensus", limit: int = DRIFT) -> DataFrame:
    """Rows beyond the limit on either side are dropped, the future too."""
    return stream.where(within_drift(F.col(ts), F.col(reference), limit))


def generations(stream: DataFrame, key: str = "id", epoch: str = "epoch", seconds: int = 3600) -> DataFrame:
    """key, epoch, accepted: refused if accepted before in this epoch or the one before.

    seconds: length of an epoch. State holds one number for each key and goes when two epochs have
    passed since, by the watermark, which follows the newest epoch at a distance of two; rows from
    before it are dropped.
    """
    kind = stream.schema[key].dataType.simpleString()
    stream = stream.withColumn("__at", F.timestamp_seconds((F.col(epoch) + 1) * seconds)).withWatermark("__at", f"{2 * seconds} seconds")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for rows in batches:
            out = []
            for e in sorted(rows[epoch]):
                fresh = last is None or e - last > 1
                last = e if fresh else last
                out.append((k[0], int(e), fresh))
            yield pd.DataFrame(out, columns=[key, "epoch", "accepted"])
        state.update((int(last),))
        state.setTimeoutTimestamp(max(1000 * seconds * (int(last) + 3), state.getCurrentWatermarkMs() + 1))

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, epoch bigint, accepted boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def packets(stream: DataFrame, sessions: DataFrame, drift: int = DRIFT, capacity: int | None = None, silence: int = 3600) -> DataFrame:
    """session_id, seq, packet_id, endpoint, outcome of packets (session_id, packet_id, seq, endpoint, mac_ok,
    ts_seconds, consensus, arrival), in this order: Drift (too early or late), Replay (the id was met in this
    window of time or the one before, even by a packet that was refused later), Full (the window has met
    capacity ids), NoSession, BadMac, OldSequence, Accepted; only then the endpoint moves.

    Windows are of twice the drift, so that an id older than two of them is refused by its time alone;
    state holds the ids of two windows of a session, the greatest sequence and the endpoint, and goes
    when the session has been silent for silence seconds of consensus time, by the watermark.
    """
    window = 2 * drift
    stream = stream.withColumn("__at", F.timestamp_seconds(F.col("consensus") + window)).withWatermark("__at", f"{3 * window} seconds")
    known = sessions.select("session_id").distinct().withColumn("known", F.lit(True))
    rows = stream.join(F.broadcast(known), "session_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (0, None, 0, [], [])
        top, at, epoch, now, before = held[0], held[1], held[2], set(held[3]), set(held[4])
        for rows in batches:
            out = []
            for r in rows.sort_values("arrival").itertuples(index=False):
                e = int(r.consensus) // window
                if e > epoch:
                    now, before, epoch = set(), (now if e == epoch + 1 else set()), e
                if abs(int(r.ts_seconds) - int(r.consensus)) > drift:
                    outcome = "Drift"
                elif r.packet_id in now or r.packet_id in before:
                    outcome = "Replay"
                elif capacity is not None and len(now) >= capacity:
                    outcome = "Full"
                else:
                    now.add(r.packet_id)
                    if not r.known:
                        outcome = "NoSession"
                    elif not r.mac_ok:
                        outcome = "BadMac"
                    elif top and r.seq <= top:
                        outcome = "OldSequence"
                    else:
                        outcome, top, at = "Accepted", int(r.seq), r.endpoint
                out.append((k[0], int(r.seq), int(r.packet_id), at, outcome))
            yield pd.DataFrame(out, columns=["session_id", "seq", "packet_id", "endpoint", "outcome"])
        state.update((top, at, epoch, sorted(now), sorted(before)))
        state.setTimeoutTimestamp(max(1000 * ((epoch + 1) * window + silence), state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("session_id").applyInPandasWithState(
        step, "session_id bigint, seq bigint, packet_id bigint, endpoint string, outcome string",
        "top bigint, endpoint string, epoch bigint, now array<bigint>, before array<bigint>", "append", GroupStateTimeout.EventTimeTimeout,
    )
