"""Points near other points, and points inside regions, over spatial partitions that fit a task.

1. A bounded sample of both sides fits a quadtree on the driver; its leaves are the partitions. A leaf that
   still holds more rows than a task should have (many rows at one spot) is cut into salts.
2. Each point goes to the one leaf that owns it. Each reference box (a place with its radius, a polygon's
   bounding box) is replicated to every leaf it touches; a polygon takes along only the edges that matter
   there, or a mark that the whole leaf lies inside it.
3. In each partition an R-tree is bulk-loaded from the boxes and probed with all points at once; candidates
   are refined by the exact distance or the even-odd rule of the ring and of each hole.
4. A pair is reported only where its reference point (the lower corner of the two boxes' intersection) lies
   in the leaf, so replication yields no pair twice.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.quadtree import QuadTree
from framelake.operators.rtree import RTree
from framelake.session import ship_package

EARTH_KM = 6371.0
KM_PER_DEGREE = math.radians(1) * EARTH_KM
#: Rows of one partition (leaf and salt) the quadtree aims at.
LEAF_ROWS = 25_000
#: Most sampled rows of each side that reach the driver to fit the quadtree.
SAMPLE_ROWS = 100_000
#: Most leaves; with more rows than LEAF_ROWS * MAX_LEAVES the leaves' salts take the rest.
MAX_LEAVES = 20_000
#: Point-edge tests done at once in the refinement, which bounds its memory.
EDGE_TESTS = 2_000_000
#: Pairs one partition may be expected to return; with more its leaf gets more salts.
PART_PAIRS = 4_000_000
#: Leaves of one polygon that are written in one batch.
REGION_ROWS = 256

DOMAIN = (-180.0, -90.0, 180.0, 90.0)  # x is lon, y is lat

PAIRS = "id bigint, match_kind string, match_id bigint"
_ITEMS = "part bigint, match_kind string, match_id bigint, x0 double, y0 double, x1 double, y1 double, lat double, lon double, whole boolean, edges binary"


def usable(lat, lon):
    """Both present, in range, no NaN, and not the (0, 0) that stands for a missing position."""
    return (
        lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    )


def haversine_km(lat1, lon1, lat2, lon2):
    """Great-circle distance of numpy arrays in degrees on a sphere of 6371 km."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


def disk_boxes(lat: np.ndarray, lon: np.ndarray, radius_km: float) -> tuple[np.ndarray, np.ndarray]:
    """(item index, box) covering a disk about each point; a disk over the date line gets two boxes."""
    slack = 1 + 1e-9
    angle = radius_km / EARTH_KM * slack
    dlat = math.degrees(angle)
    y0, y1 = lat - dlat - 1e-9, lat + dlat + 1e-9
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = np.sin(min(angle, math.pi / 2)) / np.cos(np.radians(lat))
        wide = (ratio >= 1) | (y0 <= -90) | (y1 >= 90)
        dlon = np.where(wide, 360.0, np.degrees(np.arcsin(np.minimum(ratio, 1))) + 1e-9)
    item = np.arange(len(lat))
    box = np.column_stack([np.where(wide, -180.0, lon - dlon), y0, np.where(wide, 180.0, lon + dlon), y1])
    west, east = ~wide & (box[:, 0] < -180), ~wide & (box[:, 2] > 180)
    shift = np.array([360.0, 0, 360.0, 0])
    return np.concatenate([item, item[west], item[east]]), np.concatenate([box, box[west] + shift, box[east] - shift])


def ring_edges(ring: np.ndarray) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of a ring of (lat, lon) rows, closed where it isn't; none under 3 points."""
    if len(ring) < 3:
        return np.empty((0, 4))
    points = ring[:, ::-1]
    if not np.array_equal(points[0], points[-1]):
        points = np.vstack([points, points[:1]])
    return np.hstack([points[:-1], points[1:]])


def contains(x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether points lie in a polygon of edges (x1, y1, x2, y2, part), sorted by part: 0 is the ring, others are holes.

    A point is inside where a ray eastward crosses an odd number of the ring's edges and of no hole an odd number:
    holes may overlap each other or stick out of the ring.
    """
    inside = np.zeros(len(x), dtype=bool)
    if not len(edges) or edges[0, 4] != 0:
        return inside
    step = max(1, EDGE_TESTS // len(edges))
    x1, y1, x2, y2, part = edges.T
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(y1 != y2, (x2 - x1) / (y2 - y1), 0.0)
    for at in range(0, len(x), step):
        px, py = x[at : at + step, None], y[at : at + step, None]
        crosses = ((y1 > py) != (y2 > py)) & (px < x1 + slope * (py - y1))
        odd = np.add.reduceat(crosses, starts, axis=1, dtype=np.int32) % 2 == 1
        inside[at : at + step] = odd[:, 0] & ~odd[:, 1:].any(axis=1)
    return inside


def polygon_edges(ring, holes) -> np.ndarray:
    """Edges (x1, y1, x2, y2, part) of a ring and its holes, each a list of ``{lat, lon}``; none without a ring."""

    def as_array(points) -> np.ndarray:
        rows = [(p["lat"], p["lon"]) for p in (points if points is not None else []) if p is not None and p["lat"] is not None and p["lon"] is not None]
        return np.array(rows, dtype=float).reshape(-1, 2)

    parts = [ring_edges(as_array(ring))]
    if len(parts[0]):
        parts += [ring_edges(as_array(h)) for h in (holes if holes is not None else []) if h is not None]
    return np.hstack([np.vstack(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])[:, None]])


def _crosses_box(edges: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Edges that may touch a closed box: their boxes meet it and its corners aren't all on one side."""
    x1, y1, x2, y2 = edges[:, :4].T
    meets = (np.minimum(x1, x2) <= box[2]) & (np.maximum(x1, x2) >= box[0]) & (np.minimum(y1, y2) <= box[3]) & (np.maximum(y1, y2) >= box[1])
    side = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (box[0], box[2]) for cy in (box[1], box[3])]
    return meets & ~(np.all([s > 0 for s in side], axis=0) | np.all([s < 0 for s in side], axis=0))


def _fit(points: DataFrame, places: DataFrame, leaf_rows: int, sample_rows: int, radius_km: float) -> tuple[QuadTree, np.ndarray, np.ndarray]:
    """The quadtree and, of each leaf, the salts of its points and of its places."""
    sides = []
    for side in (points, places):
        n = side.count()
        share = min(1.0, sample_rows / max(1, n))
        picked = side.select("lat", "lon") if share == 1 else side.select("lat", "lon").sample(share, seed=11)
        sides.append((n, share, picked.limit(2 * sample_rows).toPandas().to_numpy(dtype=float).reshape(-1, 2)))
    goal = max(leaf_rows, max(n for n, _, _ in sides) // MAX_LEAVES)
    weight = min(share for _, share, _ in sides)  # both samples count alike: the denser one is thinned to the other's share
    thin = [s[:: max(1, round(share / weight))] for _, share, s in sides]
    both = np.vstack(thin)
    tree = QuadTree.fit(both[:, 1].copy(), both[:, 0].copy(), max(1, int(goal * weight)), DOMAIN)
    salts = []
    for _, share, s in sides:
        held = np.bincount(tree.locate(s[:, 1].copy(), s[:, 0].copy()), minlength=len(tree.leaf_boxes)) / share
        salts.append((held, np.maximum(1, np.ceil(held / (2 * goal))).astype(np.int64)))
    (n_points, of_points), (n_places, of_places) = salts
    # Of a leaf not much larger than the radius (many rows at one spot) nearly all pairs match: the larger sides are cut
    # further, so that a partition returns a bounded number of them.
    b = tree.leaf_boxes
    height, width = (b[:, 3] - b[:, 1]) * KM_PER_DEGREE, (b[:, 2] - b[:, 0]) * KM_PER_DEGREE * np.cos(np.radians((b[:, 1] + b[:, 3]) / 2))
    pairs = n_points * n_places * np.minimum(1.0, math.pi * radius_km**2 / np.maximum(height * width, 1e-12))
    while (over := pairs > PART_PAIRS * of_points * of_places).any():
        more_points = n_points / of_points >= n_places / of_places
        of_points[over & more_points] *= 2
        of_places[over & ~more_points] *= 2
    return tree, of_points, of_places


def spatial_matches(
    points: DataFrame,
    places: DataFrame,
    polygons: DataFrame,
    radius_km: float,
    leaf_rows: int = LEAF_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``id, match_kind, match_id``: ``near`` places within ``radius_km`` and ``inside`` polygons of points.

    ``points`` and ``places`` have ``id, lat, lon``, ``polygons`` has ``polygon_id, ring, holes``; other
    columns are ignored. Rows without id or with unusable coordinates match nothing. A point delivered
    again at the same coordinates counts once; places are matched by id, each row of its own. A ring of
    fewer than three points is empty; null vertices and null holes are skipped. Empty tables match nothing.
    """
    spark = points.sparkSession
    ship_package(spark)
    keep = F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon"))
    points = points.select("id", "lat", "lon").where(keep)
    places = places.select("id", "lat", "lon").where(keep).distinct()
    tree, point_salts, place_salts = _fit(points, places, leaf_rows, sample_rows, radius_km)
    held = spark.sparkContext.broadcast((tree, point_salts, place_salts))  # at most MAX_LEAVES leaves

    # part = (leaf, salt of points, salt of places): a point goes to one salt of points and all of places,
    # an item to one salt of places and all of points, so each pair meets once.
    offset = np.concatenate([[0], np.cumsum(point_salts * place_salts)])

    def parts(leaf, point_salt, place_salt):
        return offset[leaf] + point_salt * place_salts[leaf] + place_salt

    def spread(rows: np.ndarray, leaf: np.ndarray, ids: np.ndarray, of_points: bool) -> tuple[np.ndarray, np.ndarray]:
        own, other = (point_salts, place_salts) if of_points else (place_salts, point_salts)
        copies = other[leaf]
        at = np.repeat(np.arange(len(rows)), copies)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        mine = (pd.util.hash_array(ids[at].astype(np.int64)) % own[leaf[at]].astype(np.uint64)).astype(np.int64)
        return rows[at], parts(leaf[at], mine, turn) if of_points else parts(leaf[at], turn, mine)

    def place_points(batches):
        tree = held.value[0]
        for pdf in batches:
            lat, lon, ids = pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["id"].to_numpy()
            at, part = spread(np.arange(len(pdf)), tree.locate(lon, lat), ids, True)
            yield pd.DataFrame({"part": part, "id": ids[at], "lat": lat[at], "lon": lon[at]})

    def place_disks(batches):
        tree = held.value[0]
        for pdf in batches:
            lat, lon, ids = pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["id"].to_numpy()
            item, box = disk_boxes(lat, lon, radius_km)
            which, leaf = tree.overlapping(box)
            # A place salt belongs to the place, whichever leaf it is copied to.
            rows, part = spread(which, leaf, ids[item[which]], False)
            own = item[rows]
            yield pd.DataFrame(
                {"part": part, "match_kind": "near", "match_id": ids[own], "x0": box[rows, 0], "y0": box[rows, 1], "x1": box[rows, 2], "y1": box[rows, 3]}
                | {"lat": lat[own], "lon": lon[own], "whole": False, "edges": None}
            )

    double = pa.float64()
    item_schema = pa.schema(
        [("part", pa.int64()), ("match_kind", pa.string()), ("match_id", pa.int64()), ("x0", double), ("y0", double), ("x1", double), ("y1", double)]
        + [("lat", double), ("lon", double), ("whole", pa.bool_()), ("edges", pa.binary())]
    )

    def place_regions(batches):
        tree, point_salts, _ = held.value
        for batch in batches:
            for polygon_id, ring, holes in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                edges = polygon_edges(ring, holes)
                if not len(edges):
                    continue
                own_ring = edges[edges[:, 4] == 0]
                box = np.array([own_ring[:, [0, 2]].min(), own_ring[:, [1, 3]].min(), own_ring[:, [0, 2]].max(), own_ring[:, [1, 3]].max()])
                out = []

                def batch_of(rows):
                    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), item_schema, strict=True)], schema=item_schema)

                for leaf in tree.overlapping(box[None])[1]:
                    own = tree.leaf_boxes[leaf]
                    if _crosses_box(edges, own).any():
                        low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
                        matter = edges[(low <= own[3]) & (high >= own[1]) & (np.maximum(edges[:, 0], edges[:, 2]) >= own[0])]
                        whole, packed = False, np.ascontiguousarray(matter).tobytes()
                    elif contains(np.array([(own[0] + own[2]) / 2]), np.array([(own[1] + own[3]) / 2]), edges)[0]:
                        whole, packed = True, None
                    else:
                        continue
                    clipped = [max(box[0], own[0]), max(box[1], own[1]), min(box[2], own[2]), min(box[3], own[3])]
                    out += [(int(parts(leaf, s, 0)), "inside", int(polygon_id), *clipped, None, None, whole, packed) for s in range(point_salts[leaf])]
                    if len(out) >= REGION_ROWS:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    def match(points: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "match_kind": pd.Series(dtype="object"), "match_id": pd.Series(dtype="int64")})
        if points.empty or items.empty:
            return none
        tree = held.value[0]
        points = points.drop_duplicates(["id", "lat", "lon"])
        ids, x, y = points["id"].to_numpy(), points["lon"].to_numpy(), points["lat"].to_numpy()
        leaf = int(np.searchsorted(offset, points["part"].iloc[0], side="right")) - 1
        boxes = items[["x0", "y0", "x1", "y1"]].to_numpy()
        near = (items["match_kind"] == "near").to_numpy()
        lat, lon, whole = items["lat"].to_numpy(float), items["lon"].to_numpy(float), items["whole"].to_numpy(bool)
        match_ids, packed = items["match_id"].to_numpy(), items["edges"].to_numpy()
        found = []
        for point, item in RTree(boxes).probe(x, y):
            # The reference point of a point and a box is the lower corner of their intersection.
            rx, ry = np.maximum(x[point], boxes[item, 0]), np.maximum(y[point], boxes[item, 1])
            own = tree.locate(rx, ry) == leaf
            point, item = point[own], item[own]
            good = np.zeros(len(point), dtype=bool)
            n = near[item]
            good[n] = haversine_km(y[point[n]], x[point[n]], lat[item[n]], lon[item[n]]) <= radius_km
            good[~n] = whole[item[~n]]
            for region in np.unique(item[~n & ~good]):
                mine = np.flatnonzero(item == region)
                good[mine] = contains(x[point[mine]], y[point[mine]], np.frombuffer(packed[region]).reshape(-1, 5))
            found.append(pd.DataFrame({"id": ids[point[good]], "match_kind": np.where(near[item[good]], "near", "inside"), "match_id": match_ids[item[good]]}))
        # A disk over the date line has two boxes that may share a leaf.
        return pd.concat(found).drop_duplicates() if found else none

    located = points.mapInPandas(place_points, "part bigint, id bigint, lat double, lon double")
    disks = places.mapInPandas(place_disks, _ITEMS)
    regions = polygons.select("polygon_id", "ring", "holes").where("polygon_id is not null").mapInArrow(place_regions, _ITEMS)
    return located.groupBy("part").cogroup(disks.unionByName(regions).groupBy("part")).applyInPandas(match, PAIRS)


def file_surroundings(files: DataFrame, places: DataFrame, boundaries: DataFrame, radius_km: float = 2.0, least_population: int = 1000) -> DataFrame:
    """``file_id, match_kind, match_id`` of every file with usable coordinates.

    ``near``: places of at least ``least_population`` people (null counts as none) within ``radius_km``;
    ``inside``: polygons that contain the file. A redelivered file counts once.
    """
    points = files.select(F.col("file_id").alias("id"), "lat", "lon")
    populated = places.where(F.col("population") >= least_population).select(F.col("place_id").alias("id"), "lat", "lon")
    return spatial_matches(points, populated, boundaries, radius_km).withColumnRenamed("id", "file_id")
