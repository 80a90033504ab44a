"""Time expressions: ISO text to and from Unix milliseconds, always in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?"
_ZONED = _ISO + r"([Zz]|[+-]\d{2}:\d{2})$"
_LOCAL = _ISO + "$"
_COMPACT = r"^\d{8}T\d{6}$"


def to_millis(text: Column) -> Column:
    """ISO text with a zone, without one (read as UTC) or compact; else NULL."""
    zoned = F.try_to_timestamp(F.upper(text))
    local = F.try_to_timestamp(F.concat(text, F.lit("Z")))
    compact = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyyMMdd'T'HHmmssX"))
    return F.unix_millis(
        F.when(text.rlike(_ZONED), zoned).when(text.rlike(_LOCAL), local).when(text.rlike(_COMPACT), compact)
    )


def day_of(ms: Column) -> Column:
    """The UTC day as ``yyyy-MM-dd``, whatever the session zone is."""
    days = F.floor(ms / F.lit(DAY_MS)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def _clock(ms: Column, pattern: str) -> Column:
    rest = F.pmod(ms, F.lit(DAY_MS))
    hours = F.floor(rest / 3_600_000)
    minutes = F.floor(rest / 60_000) % 60
    seconds = F.floor(rest / 1000) % 60
    return F.format_string(pattern, hours, minutes, seconds, rest % 1000)


def to_iso(ms: Column) -> Column:
    return F.concat(day_of(ms), _clock(ms, "T%02d:%02d:%02d.%03dZ"))


def compact_time(ms: Column) -> Column:
    return F.concat(F.replace(day_of(ms), F.lit("-"), F.lit("")), _clock(ms, "T%02d%02d%02d"))


def days_before(now_ms: int, days: int) -> int:
    return now_ms - days * DAY_MS
