"""Times as whole nanoseconds, local times, and cycles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_seconds_ns(seconds: Column) -> Column:
    """Exact nanoseconds of DECIMAL seconds with up to 9 digits; never through a float."""
    return (seconds.cast("decimal(19,9)") * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("long")


def rfc3339_ns(text: Column) -> tuple[Column, Column]:
    """(nanoseconds, digits of the fraction) of an RFC 3339 time; null if it is none."""
    pattern = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    zone = F.when(F.upper(part(4)) == "Z", F.lit("+00:00")).otherwise(part(4))
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), zone)))
    fraction = F.rpad(part(3), 9, "0").cast("long")
    ok = text.rlike(pattern)
    return F.when(ok, seconds * 1_000_000_000 + F.coalesce(F.when(part(3) != "", fraction), F.lit(0).cast("long"))), F.when(ok, F.length(part(3)))


def local_to_utc(local: Column, zone: Column | str) -> Column:
    """UTC time of a wall clock time in a zone; null where the clock skipped it or showed it
    twice. Candidates use the offsets of the day before, the day itself and the day after."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    found = []
    for days in (-1, 0, 1):
        probe = local + F.expr(f"INTERVAL {days} DAY")
        offset = F.unix_seconds(F.from_utc_timestamp(probe, zone)) - F.unix_seconds(probe)
        found.append(F.timestamp_seconds(F.unix_seconds(local) - offset))
    maps_back = F.filter(F.array_distinct(F.array(*found)), lambda t: F.from_utc_timestamp(t, zone) == local)
    return F.when(F.size(maps_back) == 1, F.element_at(maps_back, 1))


def cycles(ms: Column) -> list[Column]:
    """Sine and cosine of the UTC time of day and of the time of the week (Sunday is 0), to the minute."""
    minutes = F.floor(ms / 60_000)
    day = 2 * 3.141592653589793 * F.pmod(minutes, F.lit(1440)) / 1440
    week = 2 * 3.141592653589793 * F.pmod(minutes + 4 * 1440, F.lit(7 * 1440)) / (7 * 1440)
    return [F.sin(day), F.cos(day), F.sin(week), F.cos(week)]


def local_day(utc: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(utc, zone))
