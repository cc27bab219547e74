"""Five-field cron schedules as bit masks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import civil

LOOK_BACK = 7 * 24 * 60  # minutes
NAMES = ("minute", "hour", "day", "month", "weekday")
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


@dataclass(frozen=True)
class Schedule:
    """One mask for each field; all must match."""

    masks: tuple[int, int, int, int, int]

    @classmethod
    def parse(cls, text: str) -> Schedule:
        fields = text.split()
        if len(fields) != 5:
            raise ValueError(f"five fields are needed: {text!r}")
        masks = [_mask(f, lo, hi) for f, (lo, hi) in zip(fields, BOUNDS, strict=True)]
        masks[4] = masks[4] & 0x7F | masks[4] >> 7  # 7 is Sunday too
        return cls(tuple(masks))


def _mask(field: str, lo: int, hi: int) -> int:
    mask = 0
    for item in field.split(","):
        m = re.fullmatch(r"(?:(\*)|(\d+)(?:\s*-\s*(\d+))?)(?:/(\d+))?", item.strip())
        if not m:
            raise ValueError(f"bad item {item!r}")
        star, first, last, step = m.groups()
        if step is not None and first is not None and last is None:
            raise ValueError(f"a step needs a range: {item!r}")
        a, b = (lo, hi) if star else (int(first), int(last or first))
        if not lo <= a <= b <= hi or step is not None and int(step) == 0:
            raise ValueError(f"out of bounds: {item!r}")
        mask |= sum(1 << v for v in range(a, b + 1, int(step or 1)))
    return mask


def matches(ts: Column, masks: list[Column]) -> Column:
    """Whether the minute of ts has its bit in all five masks."""
    fields = civil(ts)
    found = F.lit(True)
    for name, mask in zip(NAMES, masks, strict=True):
        found = found & (F.call_function("getbit", mask.cast("bigint"), fields[name]) == 1)
    return found


def _highest(mask: Column) -> Column:
    """Number of the highest bit set; null for none."""
    return F.when(mask > 0, F.length(F.bin(mask)) - 1)


def latest_trigger(start: Column, end: Column, masks: list[Column]) -> Column:
    """The last matching minute in (start, end], both cut to minutes, at most a week back; else null.

    In closed form: of the eight days that a week touches the last one whose date matches, and there
    the highest hour and minute of the masks.
    """
    first, last = F.floor(start / 60) * 60, F.floor(end / 60) * 60
    low = F.greatest(first + 60, last - (LOOK_BACK - 1) * 60, F.lit(60))
    minute, hour, *date = (m.cast("bigint") for m in masks)
    one, midnight = F.lit(1).cast("bigint"), F.floor(last / 86400) * 86400
    shift = lambda n: F.call_function("shiftleft", one, n.cast("int"))
    h, m = F.floor((last - midnight) / 3600), F.floor((last - midnight) / 60) % 60
    same = F.when(F.call_function("getbit", hour, h.cast("int")) == 1, _highest(minute.bitwiseAND(shift(m + 1) - 1)))
    earlier = _highest(hour.bitwiseAND(shift(h) - 1)) * 60 + _highest(minute)

    def on_day(back: int) -> Column:
        day = midnight - back * 86400
        fields = civil(day)
        fits = F.lit(True)
        for name, mask in zip(NAMES[2:], date, strict=True):
            fits = fits & (F.call_function("getbit", mask, fields[name]) == 1)
        at = F.coalesce(h * 60 + same, earlier) if not back else _highest(hour) * 60 + _highest(minute)
        return F.when(fits, day + at * 60)

    hit = F.coalesce(*map(on_day, range(8)))
    return F.when((start < end) & (last >= low) & (hit >= low), hit)
