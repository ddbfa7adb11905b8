"""Coordinates and altitudes as they are written in media metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DMS = r"^(\d+),(\d+(?:\.\d+)?)(?:,(\d+(?:\.\d+)?))?\s*([NSEWnsew])$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def iso6709(text: Column) -> Column:
    """``struct(lat, lon)`` of ``+48.85+002.29[+alt]/``; null where unreadable, out of range or (0, 0)."""
    value = F.regexp_replace(text, "/+$", "")
    pattern = r"^([+-]?[^+-]*)([+-][^+-]*)"
    leading = value.rlike("^[+-]")
    lat = _number(F.when(leading, F.regexp_extract(value, r"^([+-][^+-]*)([+-][^+-]*)", 1)))
    lon = _number(F.when(leading, F.regexp_extract(value, pattern, 2)))
    good = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def xmp_coordinate(text: Column, longitude: bool) -> Column:
    """Degrees of ``40,42.768N``, ``40,42,46.08N`` or ``40.7128``; null for the other axis or out of range."""
    value = F.trim(text)
    part = lambda i: F.regexp_extract(value, _DMS, i)
    side = F.upper(part(4))
    size = part(1).try_cast("double") + part(2).try_cast("double") / 60 + F.coalesce(part(3).try_cast("double"), F.lit(0.0)) / 3600
    dms = F.when(side.isin(*(("E", "W") if longitude else ("N", "S"))), F.when(side.isin("S", "W"), -size).otherwise(size))
    degrees = F.when(value.rlike(_DMS), dms).otherwise(_number(value))
    return F.when(F.abs(degrees) <= (180 if longitude else 90), degrees)


def xmp_altitude(text: Column) -> Column:
    """A number, or a fraction ``n/d`` with d other than 0."""
    value = F.trim(text)
    fraction = F.try_divide(_number(F.trim(F.substring_index(value, "/", 1))), _number(F.trim(F.substring_index(value, "/", -1))))
    return F.when(value.contains("/"), F.when(value.rlike("^[^/]+/[^/]+$"), fraction)).otherwise(_number(value))
