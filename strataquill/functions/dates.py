"""Approximate dates: literals folded on the driver, and the relative form as a column expression."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each unit; a month has 30 days, a year 365.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d")


def parse_relative(text: str, now: int) -> int | None:
    """Seconds since the epoch of ``N units ago``."""
    m = re.fullmatch(r"(\d+)[ .]+(second|minute|hour|day|week|month|year)s?[ .]+ago", text.strip().lower())
    return now - int(m[1]) * UNITS[m[2]] if m else None


def approxidate(text: str, now: int | None = None) -> int:
    """Seconds since the epoch (UTC) of a free date: now, today, yesterday, a number, ``N units ago`` or one of FORMATS."""
    now = int(datetime.now(UTC).timestamp()) if now is None else now
    spec = text.strip().lower()
    if spec == "now":
        return now
    midnight = datetime.fromtimestamp(now, UTC).replace(hour=0, minute=0, second=0, microsecond=0)
    if spec in ("today", "yesterday"):
        return int((midnight - timedelta(days=spec == "yesterday")).timestamp())
    if re.fullmatch(r"-?\d+", spec):
        return int(spec)
    if (found := parse_relative(spec, now)) is not None:
        return found
    for f in FORMATS:
        try:
            return int(datetime.strptime(text.strip(), f).replace(tzinfo=UTC).timestamp())
        except ValueError:
            continue
    raise ValueError(f"not a date: {text!r}")


def relative_seconds(text: Column) -> Column:
    """Seconds that ``N units ago`` lies back, else null."""
    shape = r"^\s*(\d+)[ .]+(second|minute|hour|day|week|month|year)s?[ .]+ago\s*$"
    low = F.lower(text)
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(low.rlike(shape), F.regexp_extract(low, shape, 1).try_cast("long") * unit[F.regexp_extract(low, shape, 2)])


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds of a timestamp without zone, independent of the session's zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))).cast("long")
