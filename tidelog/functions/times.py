"""Times, durations and sizes: what users write, and how they are shown."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"(\d{4})([-.])(\d{2})\2(\d{2})"
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "": 1}
_SIZES = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_time(text: str, now: datetime | None = None) -> int:
    """Epoch milliseconds of RFC 3339, a date with or without a time, a time of today, or unix seconds or milliseconds.

    Forms without a zone are UTC; a number beyond 100 000 000 000 counts milliseconds.
    """
    s = text.strip()
    if m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", s):
        zone = "+00:00" if m[4] in "Zz" else m[4]
        return _ms(datetime.fromisoformat(f"{m[1]}T{m[2]}{(m[3] or '.0')[:7]}{zone}"))
    if m := re.fullmatch(_DATE + r"(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?", s):
        return _ms(datetime(int(m[1]), int(m[3]), int(m[4]), int(m[5] or 0), int(m[6] or 0), int(m[7] or 0), tzinfo=UTC))
    if m := re.fullmatch(r"(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{3}))?)?", s):
        day = (now or datetime.now(UTC)).astimezone(UTC)
        return _ms(day.replace(hour=int(m[1]), minute=int(m[2]), second=int(m[3] or 0), microsecond=1000 * int(m[4] or 0)))
    if s.isdigit():
        n = int(s)
        return n if n > 100_000_000_000 else n * 1000
    raise ValueError(f"unrecognized time {text!r}")


def _ms(t: datetime) -> int:
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def parse_duration(text: str) -> int:
    """Milliseconds of 90s, 45m, 12h, 30d, 2w or bare seconds; fractions are allowed."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([smhdw]?)", text.strip())
    if not m:
        raise ValueError(f"unrecognized duration {text!r}")
    return int(float(m[1]) * _UNITS[m[2]] * 1000)


def parse_size(text: str) -> int:
    """Bytes of 512M, 200G, 64KiB and the like, in powers of 1024."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([KMGT]?)(?:i?B)?", text.strip(), re.I)
    if not m:
        raise ValueError(f"unrecognized size {text!r}")
    return int(float(m[1]) * _SIZES[m[2].upper()])


def rfc3339(ms: Column) -> Column:
    """2026-01-02T03:04:05.678Z (sessions run in UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def shown(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def human_bytes(n: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """n in the greatest of units that it fills, to a tenth; a half goes to the even tenth, as C's printf rounds."""
    out = F.format_string("%d B", n)
    for k, unit in enumerate(units, 1):
        out = F.when(n < 1024**k, out).otherwise(F.concat(_tenths(n.cast("long"), 1024**k), F.lit(f" {unit}")))
    return out


def _tenths(n: Column, unit: int) -> Column:
    whole, rest = F.floor(n / F.lit(unit)), n % unit * 10  # a power of two divides exactly
    tenth, left = F.floor(rest / unit), rest % unit * 2
    tenth = whole * 10 + tenth + F.when((left > unit) | ((left == unit) & (tenth % 2 == 1)), 1).otherwise(0)
    return F.format_string("%d.%d", F.floor(tenth / 10), tenth % 10)


def human_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).when(h > 0, F.format_string("%dh %dm", h, m))
        .when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%d.%03ds", s, ms % 1000))
    )
