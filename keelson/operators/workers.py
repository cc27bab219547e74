"""User functions over batches with a status for each row, and budgets of I/O."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IO_FUEL = 1 << 20  # fixed value


class OutOfFuel(Exception):
    pass


@dataclass
class Host:
    """What a user function may call. Emitted rows and log lines are taken up after the call."""

    now: int
    values: dict[bytes, bytes] = field(default_factory=dict)
    blobs: dict[bytes, bytes] = field(default_factory=dict)
    fuel: int = IO_FUEL
    emitted: list[bytes] = field(default_factory=list)
    logged: list[str] = field(default_factory=list)

    def spend(self, n: int) -> None:
        """An overdraft uses up all that is left."""
        if n > self.fuel:
            self.fuel = 0
            raise OutOfFuel
        self.fuel -= n

    def get(self, key: bytes) -> bytes | None:
        value = self.values.get(key)
        self.spend(len(key) + len(value or b""))
        return value

    def set(self, key: bytes, value: bytes) -> None:
        self.spend(len(key) + len(value))
        self.values[key] = value

    def read(self, cid: bytes, offset: int, most: int) -> bytes | None:
        data = self.blobs.get(cid)
        part = None if data is None else data[offset : offset + most]
        self.spend(len(part or b""))
        return part

    def emit(self, data: bytes) -> None:
        self.spend(len(data))
        self.emitted.append(data)

    def log(self, text: str) -> None:
        self.spend(len(text))
        self.logged.append(text)


STATUS = ((OutOfFuel, "IoExhausted"), (MemoryError, "MemoryLimit"), (TimeoutError, "Deadline"), (RecursionError, "StackOverflow"), (PermissionError, "Denied"))


def status_of(error: Exception) -> str:
    return next((name for kind, name in STATUS if isinstance(error, kind)), "Trap")


def execute(tasks: DataFrame, guest: Callable[[bytes, Host], int], now: int, values: dict[bytes, bytes] | None = None, blobs: dict[bytes, bytes] | None = None) -> DataFrame:
    """task_id, status, code, fuel_used, emitted of (task_id, payload). A failing task fails alone.

    values and blobs are side inputs of the guest and must be small; larger ones are joined before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for task, payload in rows.itertuples(index=False):
                host, code, status = Host(now, dict(values or {}), blobs or {}), None, "Completed"
                try:
                    code = int(guest(bytes(payload or b""), host))
                    status = "Completed" if code == 0 else "Failed"
                except Exception as e:  # noqa: BLE001 - a guest may raise anything
                    status = status_of(e)
                out.append((task, status, code, IO_FUEL - host.fuel, host.emitted))
            yield pd.DataFrame(out, columns=["task_id", "status", "code", "fuel_used", "emitted"])

    return tasks.select("task_id", "payload").mapInPandas(run, "task_id string, status string, code int, fuel_used bigint, emitted array<binary>")


def within_budget(calls: DataFrame, budget: int = IO_FUEL) -> DataFrame:
    """calls (task_id, seq, cost) with allowed: the first overdraft ends all that follow."""
    w = W.partitionBy("task_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return calls.withColumn("__sum", F.sum("cost").over(w)).withColumn("allowed", F.col("__sum") <= budget).drop("__sum")
