"""Times: parsing of windows and durations, epoch-aligned buckets."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_WHEN = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?)?(Z|[+-]\d{2}:?\d{2})?", re.A)
#: Largest number of milliseconds that a window may have.
_MOST = 1 << 53


def duration_ms(text: str) -> int:
    """``90``, ``15m``, ``1h`` and so on in milliseconds; a bare number is seconds."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)?", text.strip(), re.A)
    if not m or not int(m[1]):
        raise ValueError(f"not a duration: {text!r} (a whole number above 0, with ms, s, m, h or d)")
    out = int(m[1]) * _UNITS[m[2] or "s"]
    if out > _MOST:
        raise ValueError(f"duration too long: {text!r}")
    return out


def instant_ms(text: str) -> int:
    """A date, or a date and time with an optional zone, as milliseconds in UTC."""
    m = _WHEN.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a date: {text!r}")
    second = min(int(m[6] or 0), 59) if int(m[6] or 0) == 60 else int(m[6] or 0)  # a leap second
    zone = UTC
    if m[8] and m[8] != "Z":
        digits = m[8][1:].replace(":", "")
        offset = timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
        zone = timezone(-offset if m[8][0] == "-" else offset)
    at = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), second, tzinfo=zone)
    return int(at.timestamp()) * 1000 + int((m[7] or "0").ljust(3, "0")[:3])


def bucket(at_ms: Column, width: int) -> Column:
    """Start of the epoch-aligned bucket of ``width`` ms, also before 1970."""
    return at_ms - F.pmod(at_ms, F.lit(width))


def epoch_ms(number: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds, told apart by size, as milliseconds."""
    size = F.abs(number)
    return F.floor(
        F.when(size < 1e11, number * 1000).when(size < 1e14, number).when(size < 1e17, number / 1000).otherwise(number / 1_000_000)
    ).cast("long")


def parsed_ms(text: Column) -> Column:
    """A text that is a number or an RFC 3339 time as milliseconds; null if it is neither."""
    number = F.when(text.rlike(r"^[+-]?[0-9]{9,}(\.[0-9]+)?$"), epoch_ms(text.cast("double")))
    strict = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?$")
    stamp = F.try_to_timestamp(F.when(strict, F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")))
    return F.coalesce(number, F.floor(F.unix_micros(stamp) / 1000).cast("long"))


def utc_date(at_ms: Column) -> Column:
    """The day of a time in UTC, ``YYYY-MM-DD``."""
    return F.date_format(F.timestamp_millis(at_ms), "yyyy-MM-dd")


def day_of(job: Column, at_ms: Column) -> Column:
    """The day that a job's name begins with (eight digits), else that of its time."""
    day = F.concat_ws("-", F.substring(job, 1, 4), F.substring(job, 5, 2), F.substring(job, 7, 2))
    return F.when(job.rlike("^[0-9]{8}"), day).otherwise(utc_date(at_ms))
