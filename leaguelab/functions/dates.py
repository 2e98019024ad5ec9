"""Dates and times written in German or ISO form, and local wall clock to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

LOCAL_ZONE = "Europe/Berlin"
_GERMAN = (
    r"(?<!\d)(\d{1,2})\.[\s\u00a0]*(\d{1,2})\.[\s\u00a0]*(\d{4}|\d{2})(?!\d)"
    r"(?:[\s\u00a0]+(\d{1,2}):(\d{2}))?"
)
_ISO = r"^[\s\u00a0]*(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2}))?"


def _parts(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Struct of a checked wall-clock time; NULL when the calendar date does not exist."""
    has_time = hour.isNotNull()
    hh, mm = F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:00", year, month, day, hh, mm)
    ts = F.when(year.isNotNull() & hh.between(0, 23) & mm.between(0, 59), text).try_cast(
        "timestamp_ntz"
    )
    return let(
        F.struct(ts.alias("ts"), has_time.alias("t")),
        lambda v: F.when(
            v["ts"].isNotNull(),
            F.struct(v["ts"].alias("ts"), v["ts"].cast("date").alias("day"), v["t"].alias("has_time")),
        ),
    )


def _int(c: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(c, pattern, index).try_cast("int")


def german_date(c: Column) -> Column:
    """``(ts, day, has_time)`` of the first 'd. m. yyyy [hh:mm]' in a text."""
    # One search, then the numbers of the hit: day, month, year and perhaps hour and minute.
    found = F.split(F.regexp_extract(c, _GERMAN, 0), "[^0-9]+")
    numbers = F.transform(found, lambda x: x.try_cast("int"))
    return let(
        numbers,
        lambda p: _parts(
            F.get(p, F.lit(2)) + F.when(F.get(p, F.lit(2)) < 100, 2000).otherwise(0),
            *[F.get(p, F.lit(i)) for i in (1, 0, 3, 4)],
        ),
    )


def iso_date(c: Column) -> Column:
    """``(ts, day, has_time)`` of an ISO date or wall-clock time."""
    return _parts(*[_int(c, _ISO, i) for i in (1, 2, 3, 4, 5)])


def berlin_to_utc(ts: Column, strict: bool = True, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall clock of a local wall clock.

    NULL when the local time does not exist (spring gap) and, if ``strict``, also when it exists
    twice (autumn overlap).
    """
    to_utc = lambda w: F.convert_timezone(F.lit(zone), F.lit("UTC"), w)

    def back(there: Column, hours: int) -> Column:
        shifted = there + F.expr(f"INTERVAL '{hours}' HOUR")
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), shifted)

    def check(wall: Column, there: Column) -> Column:
        ok = back(there, 0) == wall
        if strict:
            ok = ok & (back(there, 1) != wall) & (back(there, -1) != wall)
        return F.when(ok, there)

    return let(
        ts.cast("timestamp_ntz"), lambda w: let(to_utc(w), lambda there: check(w, there))
    )
