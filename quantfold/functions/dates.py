"""Date and time expressions (session time zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mathx import col_
from .text import drop_first_word

NEW_YORK = "America/New_York"


def iso_to_local_midnight(c, tz: str = NEW_YORK) -> Column:
    """ISO timestamp with offset -> wall clock in ``tz`` -> naive midnight."""
    instant = F.to_timestamp(col_(c))
    return F.date_trunc("day", F.from_utc_timestamp(instant, tz))


def parse_us_datetime(c, strict: bool = True) -> Column:
    """``m/d/Y, h:mm AM`` after a leading word (``Published 01/02/2020, 3:04 PM``)."""
    txt = drop_first_word(c)
    fmt = "M/d/yyyy, h:mm a"
    ts = F.to_timestamp(txt, fmt) if strict else F.try_to_timestamp(txt, F.lit(fmt))
    return F.date_trunc("day", ts)


def parse_duration_us(window: str) -> int:
    """Fixed-length duration -> microseconds ('365D', '12h', '30min', '1 day', ...).

    Calendar lengths ('12M', '1Y') are rejected as in the reference's library.
    """
    import re

    w = window.strip()
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)", w)
    if not m:
        raise ValueError(f"unsupported window {window!r}")
    n, unit = float(m.group(1)), m.group(2).lower()
    units = {
        "d": 86400, "day": 86400, "days": 86400,
        "h": 3600, "hour": 3600, "hours": 3600,
        "min": 60, "t": 60, "minute": 60, "minutes": 60,
        "s": 1, "sec": 1, "second": 1, "seconds": 1,
        "w": 7 * 86400, "week": 7 * 86400, "weeks": 7 * 86400,
        "ms": 0.001, "us": 1e-6,
    }
    if unit not in units:
        raise ValueError(f"{window!r} is not a fixed frequency")
    return int(round(n * units[unit] * 1_000_000))
