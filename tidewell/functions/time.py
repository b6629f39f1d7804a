"""Event time as epoch milliseconds, without the session's time zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def interval_ms(text: str | int) -> int:
    """'5 SECOND' or '1 hour 30 minutes' in ms; a bare number is seconds; an int is ms. Months and years have no fixed length."""
    if isinstance(text, int):
        return text
    parts = re.findall(r"(-?\d+(?:\.\d+)?)\s*([A-Za-z]*)", text)
    if not parts or re.sub(r"(-?\d+(?:\.\d+)?)\s*([A-Za-z]*)", "", text).strip():
        raise ValueError(f"no interval: {text!r}")
    total = 0.0
    for n, unit in parts:
        u = unit.lower().rstrip("s") or "second"
        u = {"ms": "millisecond", "m": "millisecond", "min": "minute", "sec": "second", "hr": "hour", "h": "hour", "d": "day"}.get(u, u)
        if unit.lower() == "ms":
            u = "millisecond"
        if u not in UNITS:
            raise ValueError(f"unsupported interval unit: {unit!r}")
        total += float(n) * UNITS[u]
    return int(total)


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ or TIMESTAMP column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def millis(ts: str | Column) -> Column:
    """Milliseconds, rounded down also before 1970."""
    u = micros(ts)
    return ((u - F.pmod(u, F.lit(1000))) / 1000).cast("long")


def from_millis(ms: Column) -> Column:
    """TIMESTAMP_NTZ from epoch milliseconds."""
    return F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
