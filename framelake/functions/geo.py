"""Geohash cells, great-circle distance and polygons as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_KM = 6371.0
EDGE_DEGREES = 1e-4
MICRO = 1_000_000


def _bits(precision: int) -> tuple[int, int]:
    """(longitude, latitude) bits of a geohash."""
    if not 1 <= precision <= 12:
        raise ValueError("precision is 1 to 12")
    return (5 * precision + 1) // 2, 5 * precision // 2


def cell_x(lon: Column, precision: int) -> Column:
    """Column number of the cell, counted from -180."""
    n = 1 << _bits(precision)[0]
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), F.lit(n - 1)).cast("bigint")


def cell_y(lat: Column, precision: int) -> Column:
    """Row number of the cell, counted from -90."""
    n = 1 << _bits(precision)[1]
    return F.least(F.greatest(F.floor((lat + 90) / 180 * n), F.lit(0)), F.lit(n - 1)).cast("bigint")


def cell_code(x: Column, y: Column, precision: int) -> Column:
    """The interleaved bits of a cell, longitude first."""
    nx, ny = _bits(precision)
    code = F.lit(0).cast("bigint")
    for i in range(nx + ny):
        # Bit i from the top is of longitude where i is even.
        source, place = (x, nx - 1 - i // 2) if i % 2 == 0 else (y, ny - 1 - i // 2)
        code = code.bitwiseOR(F.shiftleft(F.shiftright(source, place).bitwiseAND(F.lit(1).cast("bigint")), nx + ny - 1 - i))
    return code


def cell_hash(x: Column, y: Column, precision: int) -> Column:
    """The base-32 text of a cell."""
    code = cell_code(x, y, precision)
    letters = [F.substring(F.lit(ALPHABET), (F.shiftright(code, 5 * (precision - 1 - i)).bitwiseAND(F.lit(31).cast("bigint")) + 1).cast("int"), F.lit(1)) for i in range(precision)]
    return F.concat(*letters)


def geohash(lat: Column, lon: Column, precision: int = 4) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), cell_hash(cell_x(lon, precision), cell_y(lat, precision), precision))


def cell_bounds(x: Column, y: Column, precision: int) -> Column:
    """``struct(min_lat, min_lon, max_lat, max_lon)`` of a cell."""
    nx, ny = _bits(precision)
    dx, dy = 360.0 / (1 << nx), 180.0 / (1 << ny)
    return F.struct((y * dy - 90).alias("min_lat"), (x * dx - 180).alias("min_lon"), ((y + 1) * dy - 90).alias("max_lat"), ((x + 1) * dx - 180).alias("max_lon"))


def neighbour_cells(x: Column, y: Column, precision: int, ring: int = 1) -> Column:
    """``array<struct<x, y>>`` of the cell and those around it: rows beyond a pole are left out, columns wrap."""
    nx, ny = _bits(precision)
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    cells = F.flatten(F.transform(steps, lambda dy: F.transform(steps, lambda dx: F.struct(F.pmod(x + dx, F.lit(1 << nx)).alias("x"), (y + dy).alias("y")))))
    return F.array_distinct(F.filter(cells, lambda c: c["y"].between(0, (1 << ny) - 1)))


def cells_within(lat: Column, lon: Column, km: float, precision: int) -> Column:
    """``array<struct<x, y>>`` of every cell that a circle about a position touches; columns wrap."""
    n = 1 << _bits(precision)[0]
    angle = km / EARTH_KM
    high = math.degrees(angle) + 1e-9
    reach = F.sin(F.lit(min(angle, math.pi / 2))) / F.cos(F.radians(lat))
    polar = (F.abs(lat) + high >= 90) | (reach >= 1)
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))) + 1e-9)
    left, right = F.floor((lon - wide + 180) / 360 * n), F.floor((lon + wide + 180) / 360 * n)
    columns = F.array_distinct(F.transform(F.sequence(left, F.least(right, left + n - 1)), lambda c: F.pmod(c, F.lit(n))))
    rows = F.sequence(cell_y(lat - high, precision), cell_y(lat + high, precision))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(x.cast("bigint").alias("x"), y.alias("y")))))


def ancestors(cell: Column) -> Column:
    """The proper prefixes of a geohash, shortest first; empty for one letter."""
    return F.when(F.length(cell) <= 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(cell) - 1), lambda n: F.substring(cell, F.lit(1), n)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def normalise_longitude(lon: Column) -> Column:
    """Into [-180, 180]; 180 stays 180."""
    return F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)


def clamp_latitude(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0))


def quantise(degrees: Column, scale: int) -> Column:
    """Degrees cut (not rounded) to 1/scale."""
    return (degrees * scale).cast("bigint") / scale


def ring_edges(ring: Column) -> Column:
    """``array<struct<a, b>>`` of consecutive vertices, the last joined to the first; empty under 3 vertices."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.when(F.size(ring) >= 3, F.arrays_zip(ring.alias("a"), after.alias("b"))).otherwise(F.array().cast("array<struct<a:struct<lat:double,lon:double>,b:struct<lat:double,lon:double>>>"))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule; false for a ring of fewer than 3 vertices."""

    def crosses(e: Column) -> Column:
        ay, by, ax, bx = e["a"]["lat"], e["b"]["lat"], e["a"]["lon"], e["b"]["lon"]
        return ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / F.when(by != ay, by - ay) + ax)

    return F.size(F.filter(ring_edges(ring), crosses)) % 2 == 1


def point_in_polygon(lat: Column, lon: Column, ring: Column, holes: Column) -> Column:
    """Inside the ring and inside no hole."""
    return point_in_ring(lat, lon, ring) & ~F.exists(F.coalesce(holes, F.array()), lambda h: point_in_ring(lat, lon, h))


def on_edge(lat: Column, lon: Column, ring: Column, tolerance: float = EDGE_DEGREES) -> Column:
    """Within ``tolerance`` degrees of an edge of the ring."""

    def near(e: Column) -> Column:
        ax, ay = e["a"]["lon"], e["a"]["lat"]
        dx, dy = e["b"]["lon"] - ax, e["b"]["lat"] - ay
        square = dx * dx + dy * dy
        along = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((lon - ax) * dx + (lat - ay) * dy) / F.when(square != 0, square), F.lit(0.0)), F.lit(1.0)))
        return F.hypot(lon - (ax + along * dx), lat - (ay + along * dy)) < tolerance

    return F.exists(ring_edges(ring), near)


def bounding_box(ring: Column) -> Column:
    lats, lons = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return F.struct(F.array_min(lats).alias("min_lat"), F.array_min(lons).alias("min_lon"), F.array_max(lats).alias("max_lat"), F.array_max(lons).alias("max_lon"))


def box_contains(box: Column, lat: Column, lon: Column) -> Column:
    return lat.between(box["min_lat"], box["max_lat"]) & lon.between(box["min_lon"], box["max_lon"])


def boxes_intersect(a: Column, b: Column) -> Column:
    return (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"]) & (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"])


def place_type(code: Column, population: Column) -> Column:
    """0 district, 1 village, 2 town, 3 city, 4 seat of a division, 5 capital."""
    people = F.coalesce(population, F.lit(0))
    return (
        F.when(code == "PPLC", 5).when(code.startswith("PPLA"), 4).when(code == "PPLX", 0).when(code == "PPLL", 1)
        .when(people >= 100_000, 3).when(people >= 10_000, 2).otherwise(1)
    )


def feature_priority(code: Column) -> Column:
    """How well a kind of place names a location; higher is better."""
    return (
        F.when(code == "PPLC", 100).when(code.startswith("PPLA"), 80).when(code == "PPL", 60).when(code == "PPLX", 40).when(code == "PPLL", 20)
        .when(code.startswith("PPL"), 50).otherwise(10)
    )
