"""Chosen timestamps, clock and zone corrections, and written offsets."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = re.compile(r"([+-])(?:(\d+)d)?(?:(\d{1,2}):(\d{2}))?")

#: Written forms of dates in sidecars, tried in this order.
SIDECAR_DATE_FORMS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd")


def chosen_timestamp(taken: Column, created: Column, modified: Column) -> Column:
    """``struct(ts, source)``: the first that is known of taken, created, modified."""
    return F.struct(
        F.coalesce(taken, created, modified).alias("ts"),
        F.when(taken.isNotNull(), "taken").when(created.isNotNull(), "created").when(modified.isNotNull(), "modified").alias("source"),
    )


def parse_offset(text: str) -> timedelta:
    """``+2:00``, ``-1d``, ``+1d2:30`` as a timedelta; ValueError for anything else."""
    m = _OFFSET.fullmatch(text.strip())
    if not m or not (m[2] or m[3]):
        raise ValueError(f"not a time offset: {text!r}")
    hours, minutes = int(m[3] or 0), int(m[4] or 0)
    if hours > 23 or minutes > 59:
        raise ValueError(f"hours are at most 23 and minutes 59: {text!r}")
    span = timedelta(days=int(m[2] or 0), hours=hours, minutes=minutes)
    return -span if m[1] == "-" else span


def format_offset(span: timedelta) -> str:
    """The shortest writing that :func:`parse_offset` reads back."""
    minutes = abs(span) // timedelta(minutes=1)
    days, rest = divmod(minutes, 1440)
    clock = f"{rest // 60}:{rest % 60:02d}" if rest or not days else ""
    return ("-" if span < timedelta(0) else "+") + (f"{days}d" if days else "") + clock


def offset_interval(text: Column) -> Column:
    """A written offset as a day-time interval; null where it isn't one."""
    pattern = r"^([+-])(?:(\d+)d)?(?:(\d{1,2}):(\d{2}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("int"), F.lit(0))
    valid = text.rlike(pattern) & (F.length(text) > 1) & (part(3) <= 23) & (part(4) <= 59)
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(valid, F.make_dt_interval(sign * part(2), sign * part(3), sign * part(4)))


def shifted(ts: Column, offset: timedelta | None) -> Column:
    """The timestamp moved by an offset; none and zero change nothing."""
    if not offset:
        return ts
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(offset // timedelta(microseconds=1)))


def longitude_offset_hours(lon: Column) -> Column:
    """Hours from UTC by longitude, to the half hour, midpoints to even."""
    return F.bround(lon / 15 * 2) / 2


def in_zone(ts: Column, mode: str, zone: str = "UTC", lon: Column | None = None) -> Column:
    """Wall-clock time: ``original`` (as is), ``local`` (UTC shown in ``zone``) or ``gps`` (by longitude; as is without one)."""
    if mode == "original":
        return ts
    if mode == "local":
        return F.from_utc_timestamp(ts, zone)
    if mode == "gps":
        return F.coalesce(F.timestamp_micros(F.unix_micros(ts) + (longitude_offset_hours(lon) * 3600 * 1000000).cast("bigint")), ts)
    raise ValueError(f"unknown zone mode {mode!r}")


def sidecar_date(text: Column) -> Column:
    """The first of SIDECAR_DATE_FORMS that reads the text; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in SIDECAR_DATE_FORMS])
