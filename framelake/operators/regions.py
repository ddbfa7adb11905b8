"""Countries of positions by their borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.geo import cell_bounds, cell_x, cell_y, ring_edges
from framelake.operators.enrich import has_coordinates
from framelake.session import ship_package

PRECISION = 3
TOLERANCE = 0.01
#: Degrees by which a cell's box is taken wider than it is, for rounding.
_SLACK = 1e-9


def _whole_points(ring: Column) -> Column:
    return F.filter(ring, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def _edges(ring: Column, part: Column) -> Column:
    """``array<struct<x1, y1, x2, y2, part>>`` of a ring; null vertices are skipped, fewer than 3 give none."""
    edge = lambda e: F.struct(e["a"]["lon"].alias("x1"), e["a"]["lat"].alias("y1"), e["b"]["lon"].alias("x2"), e["b"]["lat"].alias("y2"), part.cast("int").alias("part"))
    return F.transform(ring_edges(_whole_points(ring)), edge)


def polygon_edges(boundaries: DataFrame) -> DataFrame:
    """``country, polygon_id, edges`` of polygons with a ring of 3 points at least: part 0 is the ring, others are holes."""
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,part:int>>")
    holes = F.flatten(F.transform(F.filter(F.coalesce("holes", F.array()), lambda h: h.isNotNull()), lambda h, i: _edges(h, i + 1)))
    ring = _edges(F.col("ring"), F.lit(0))
    return boundaries.select("country", "polygon_id", ring.alias("_ring"), F.coalesce(holes, none).alias("_holes")).where(F.size("_ring") > 0).select("country", "polygon_id", F.concat("_ring", "_holes").alias("edges"))


def _crossed_parts(lat: Column, lon: Column, edges: Column) -> Column:
    """The parts of the edges that a ray eastward crosses, one item for each crossing."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.when(e["y1"] != e["y2"], e["y2"] - e["y1"]) + e["x1"])

    return F.transform(F.filter(edges, crosses), lambda e: e["part"])


def _inside(parts: Column) -> Column:
    """Whether crossings put a point into a ring and into no hole."""
    odd = lambda part: F.size(F.filter(parts, lambda p: p == part)) % 2 == 1
    return odd(F.lit(0)) & ~F.exists(F.array_distinct(F.filter(parts, lambda p: p > 0)), odd)


def contains(lat: Column, lon: Column, edges: Column) -> Column:
    return _inside(_crossed_parts(lat, lon, edges))


def polygon_cells(boundaries: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``x, y, country, polygon_id, whole, edges``: the cells that a polygon meets, with what decides there.

    Where no edge touches the cell, ``whole`` tells that it lies inside (cells outside are left out) and there are no
    edges. Elsewhere ``edges`` are those that a ray eastward from within the cell may cross: a cell takes along only
    these, so the shuffled size grows with the border and not with border times cells.
    """
    shapes = polygon_edges(boundaries)
    of = lambda name, pick: pick(F.transform(F.filter("edges", lambda e: e["part"] == 0), lambda e: e[name]))
    shapes = shapes.withColumns({"_y": F.sequence(cell_y(of("y1", F.array_min), precision), cell_y(of("y1", F.array_max), precision)), "_x": F.sequence(cell_x(of("x1", F.array_min), precision), cell_x(of("x1", F.array_max), precision))})
    box = cell_bounds(F.lit(0), F.col("y"), precision)
    rows = shapes.withColumn("y", F.explode("_y")).withColumns({"_low": box["min_lat"], "_high": box["max_lat"]})
    in_row = F.filter("edges", lambda e: (F.least(e["y1"], e["y2"]) <= F.col("_high") + _SLACK) & (F.greatest(e["y1"], e["y2"]) >= F.col("_low") - _SLACK))
    rows = rows.select("country", "polygon_id", "y", "_low", "_high", in_row.alias("edges"), F.explode("_x").alias("x"))
    box = cell_bounds(F.col("x"), F.lit(0), precision)
    cells = rows.withColumns({"_left": box["min_lon"], "_right": box["max_lon"]})
    cells = cells.withColumn("edges", F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= F.col("_left") - _SLACK))
    touched = F.exists("edges", lambda e: F.least(e["x1"], e["x2"]) <= F.col("_right") + _SLACK)
    cells = cells.withColumns({"touched": touched, "_middle": _crossed_parts((F.col("_low") + F.col("_high")) / 2, (F.col("_left") + F.col("_right")) / 2, F.col("edges"))})
    cells = cells.withColumn("whole", ~F.col("touched") & _inside(F.col("_middle"))).where("touched or whole")
    return cells.select("x", "y", "country", "polygon_id", "whole", F.when(F.col("touched"), F.col("edges")).alias("edges"))


_CELLS = "x bigint, y bigint, country string, polygon_id int, whole boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double,part:int>>"


def write_border_index(boundaries: DataFrame, path: str, precision: int = PRECISION) -> None:
    """Prepared borders: :func:`polygon_cells` as parquet clustered by cell."""
    polygon_cells(boundaries, precision).withColumn("precision", F.lit(precision)).repartitionByRange("x", "y").sortWithinPartitions("x", "y").write.mode("overwrite").parquet(path)


def read_border_index(spark: SparkSession, path: str) -> DataFrame:
    """Prepared borders, which the lookups take in place of boundaries of the same precision."""
    return spark.read.schema(_CELLS + ", precision int").parquet(path)


def _cells_of(boundaries: DataFrame, precision: int) -> DataFrame:
    if "edges" not in boundaries.columns:
        return polygon_cells(boundaries, precision)
    return boundaries.where(F.col("precision") == precision).drop("precision")


def containing_polygons(points: DataFrame, boundaries: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``lat, lon, country, polygon_id``: the polygons that contain each distinct position.

    An equi-join on cells brings a position together with the polygons that meet its cell; there either the whole
    cell lies inside or the even-odd rule of the cell's edges decides.
    """
    at = points.where(has_coordinates(F.col("lat"), F.col("lon"))).select("lat", "lon").distinct()
    at = at.withColumns({"x": cell_x(F.col("lon"), precision), "y": cell_y(F.col("lat"), precision)})
    met = at.join(_cells_of(boundaries, precision), ["x", "y"])
    met = met.withColumn("crossed", F.when(~F.col("whole"), _crossed_parts(F.col("lat"), F.col("lon"), F.col("edges"))))
    return met.where(F.col("whole") | _inside(F.col("crossed"))).select("lat", "lon", F.trim("country").alias("country"), "polygon_id")


def country_lookup(points: DataFrame, boundaries: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``lat, lon, country, candidates, is_ocean, is_border``: one row for each distinct usable position.

    ``country`` is the smallest code whose polygons contain it, ``candidates`` all of them, sorted;
    ``is_border`` tells that there is more than one, ``is_ocean`` that there is none.
    """
    at = points.where(has_coordinates(F.col("lat"), F.col("lon"))).select("lat", "lon").distinct()
    found = containing_polygons(at, boundaries, precision).groupBy("lat", "lon").agg(F.array_sort(F.collect_set("country")).alias("candidates"))
    got = at.join(found, ["lat", "lon"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return got.select("lat", "lon", F.get("candidates", F.lit(0)).alias("country"), "candidates", (F.size("candidates") == 0).alias("is_ocean"), (F.size("candidates") > 1).alias("is_border"))


def edge_points(points: DataFrame, boundaries: DataFrame, tolerance: float = 1e-4, precision: int = PRECISION) -> DataFrame:
    """``lat, lon, polygon_id``: positions within ``tolerance`` degrees of a ring's edge, also across the antimeridian.

    Each edge goes to the cells that its box, widened by the tolerance, touches; positions meet only the edges of their cell.
    """
    at = points.where(has_coordinates(F.col("lat"), F.col("lon"))).select("lat", "lon").distinct()
    at = at.withColumns({"x": cell_x(F.col("lon"), precision), "y": cell_y(F.col("lat"), precision)})
    edges = polygon_edges(boundaries).select("polygon_id", F.inline("edges")).where("part = 0").drop("part")
    more = tolerance + _SLACK
    west, east = F.least("x1", "x2") - more, F.greatest("x1", "x2") + more
    # An edge that reaches beyond the antimeridian is met from the other side as well, moved by a turn.
    turns = F.concat(F.array(F.lit(0.0)), F.when(east > 180, F.array(F.lit(-360.0))).otherwise(F.array()), F.when(west < -180, F.array(F.lit(360.0))).otherwise(F.array()))
    edges = edges.withColumn("turn", F.explode(turns)).withColumns({"x1": F.col("x1") + F.col("turn"), "x2": F.col("x2") + F.col("turn")})
    span = lambda cell, a, b: F.explode(F.sequence(cell(F.least(a, b) - more, precision), cell(F.greatest(a, b) + more, precision)))
    edges = edges.withColumn("x", span(cell_x, "x1", "x2")).withColumn("y", span(cell_y, "y1", "y2")).drop("turn")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    along = F.when(square > 0, ((F.col("lon") - F.col("x1")) * dx + (F.col("lat") - F.col("y1")) * dy) / F.when(square > 0, square)).otherwise(0.0)
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    near = F.hypot(F.col("lon") - (F.col("x1") + along * dx), F.col("lat") - (F.col("y1") + along * dy)) < tolerance
    return at.join(edges, ["x", "y"]).where(near).select("lat", "lon", "polygon_id").distinct()


def cell_countries(boundaries: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``x, y, countries, is_border``: the countries that contain a cell's centre or one of its corners."""
    cells = polygon_cells(boundaries, precision)
    b = cell_bounds(F.col("x"), F.col("y"), precision)
    spots = F.array(
        F.struct(((b["min_lat"] + b["max_lat"]) / 2).alias("lat"), ((b["min_lon"] + b["max_lon"]) / 2).alias("lon")),
        *[F.struct(b[la].alias("lat"), b[lo].alias("lon")) for la in ("min_lat", "max_lat") for lo in ("min_lon", "max_lon")],
    )
    held = cells.where(F.col("whole") | F.exists(spots, lambda p: contains(p["lat"], p["lon"], F.col("edges"))))
    return held.groupBy("x", "y").agg(F.array_sort(F.collect_set(F.trim("country"))).alias("countries")).withColumn("is_border", F.size("countries") > 1)


def simplify_ring(ring: list, tolerance: float = TOLERANCE) -> list:
    """Douglas-Peucker on (lat, lon) points with an explicit stack; up to 4 points stay, the ring is closed again."""
    points = np.asarray(ring, dtype=float).reshape(-1, 2)
    if len(points) <= 4:
        return points.tolist()
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        a, b, mid = points[lo], points[hi], points[lo + 1 : hi]
        d = b - a
        length = np.hypot(*d)
        gap = np.hypot(*(mid - a).T) if length == 0 else np.abs(d[0] * (mid[:, 1] - a[1]) - d[1] * (mid[:, 0] - a[0])) / length
        far = int(gap.argmax())
        if gap[far] > tolerance:
            keep[lo + 1 + far] = True
            stack += [(lo, lo + 1 + far), (lo + 1 + far, hi)]
    out = points[keep].tolist()
    return out if out[0] == out[-1] else [*out, out[0]]


def simplified(boundaries: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``country, polygon_id, ring``: rings with fewer vertices, none moved by more than the tolerance."""

    def run(batches):
        for pdf in batches:
            rings = [simplify_ring([(p["lat"], p["lon"]) for p in r if p is not None], tolerance) if r is not None else [] for r in pdf["ring"]]
            yield pd.DataFrame({"country": pdf["country"], "polygon_id": pdf["polygon_id"], "ring": [[{"lat": la, "lon": lo} for la, lo in r] for r in rings]})

    ship_package(boundaries.sparkSession)
    return boundaries.select("country", "polygon_id", "ring").mapInPandas(run, "country string, polygon_id int, ring array<struct<lat:double,lon:double>>")
