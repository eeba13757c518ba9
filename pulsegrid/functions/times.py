"""Durations and time bounds given as text, resolved once on the driver."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def micros(duration: str | float | timedelta) -> int:
    """Microseconds of 5m, 1h30m, 250ms, a timedelta, or a number of nanoseconds."""
    if isinstance(duration, timedelta):
        return round(duration.total_seconds() * 1e6)
    if isinstance(duration, int | float):
        return int(duration // 1000)
    text = duration.strip()
    sign = -1 if text.startswith("-") else 1
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", text.lstrip("+-"))
    if text.lstrip("+-") != "0" and (not parts or "".join(a + b for a, b in parts) != text.lstrip("+-")):
        raise ValueError(f"not a duration: {duration!r}")
    return sign * round(sum(float(n) * _UNITS[u] for n, u in parts))


def resolve_relative_time(text: str, now: datetime) -> datetime | None:
    """A bound given as nothing, `now`, an offset such as -1h, or a time with its zone."""
    text = text.strip()
    if not text:
        return None
    if text == "now":
        return now
    if text[0] in "+-":
        return now + timedelta(microseconds=micros(text))
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError(f"a time needs its zone: {text!r}")
    return at


def utc_date(ts: Column) -> Column:
    """The date of a time in UTC, whatever the session's zone."""
    us, day = F.unix_micros(ts), F.lit(_UNITS["d"])
    return F.date_from_unix_date(((us - F.pmod(us, day)) / day).cast("int"))


def epoch_micros(at: datetime | int) -> int:
    """Microseconds since 1970; a time without a zone is taken as UTC."""
    if isinstance(at, int):
        return at
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return round((at - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
