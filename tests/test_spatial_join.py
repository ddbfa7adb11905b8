import numpy as np
import pytest

from framelake.operators.quadtree import QuadTree
from framelake.operators.rtree import RTree
from framelake.operators.spatial_join import contains, disk_boxes, haversine_km, polygon_edges, spatial_matches

POINT = "id bigint, lat double, lon double, part bigint, match_id string"
POLYGON = "polygon_id int, ring array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>, country string"


def square(y, x, size):
    return [(y, x), (y, x + size), (y + size, x + size), (y + size, x)]


def points(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], POINT)


def odd(x, y, ring):
    """The even-odd rule, edge by edge."""
    edges = zip(ring, ring[1:] + ring[:1], strict=True) if len(ring) > 2 else []
    return sum((a[0] > y) != (b[0] > y) and x < a[1] + (b[1] - a[1]) * (y - a[0]) / (b[0] - a[0]) for a, b in edges) % 2 == 1


def brute(pts, places, polygons, radius):
    out = set()
    ok = lambda r: None not in r and abs(r[1]) <= 90 and abs(r[2]) <= 180 and (r[1] or r[2])
    for p in filter(ok, set(pts)):
        out |= {(p[0], "near", q[0]) for q in filter(ok, places) if haversine_km(p[1], p[2], q[1], q[2]) <= radius}
        for pid, ring, holes, _ in polygons:
            if odd(p[2], p[1], ring) and not any(odd(p[2], p[1], h) for h in holes or [] if h):
                out.add((p[0], "inside", pid))
    return out


@pytest.mark.parametrize("leaf_rows", [5, 60, 100_000])
def test_against_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(4)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-3, 3, 300), rng.uniform(-3, 3, 300)))]
    pts += [(1000 + i, 1.25, 1.25) for i in range(150)]  # one spot holds a third
    pts += [(2000 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 60), rng.choice([-179.999, 179.999, 180.0, -180.0], 60)))]
    pts += [(3000, 89.999, 10.0), (3001, -90.0, 0.0), (3002, 0.0, 0.0), (3003, None, 1.0), (3004, 91.0, 1.0), (3005, 1.0, 181.0), (5, pts[5][1], pts[5][2]), (None, 1.0, 1.0)]
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-3, 3, 80), rng.uniform(-3, 3, 80)))]
    places += [(500, 1.25, 1.26), (501, 1.25, 1.26), (502, 89.9995, -170.0), (503, 0.0, 0.0), (504, None, None)]
    places += [(600 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 40), rng.choice([-179.99, 179.99], 40)))]
    polygons = [
        (1, square(-1.0, -1.0, 3.0), [square(0.0, 0.0, 0.5)], "A"), (2, square(-2.5, -2.5, 5.0) + [(-2.5, -2.5)], [], "B"), (3, [(0.0, 0.0), (1.0, 1.0)], None, "C"),
        (4, [(-90.0, 170.0), (90.0, 170.0), (90.0, 180.0), (-90.0, 180.0)], [None, []], "D"), (5, [], [], None),
    ]
    got = spatial_matches(points(spark, pts), points(spark, places), spark.createDataFrame(polygons, POLYGON), 30.0, leaf_rows=leaf_rows)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute([p for p in pts if p[0] is not None], places, polygons, 30.0)


@pytest.mark.parametrize("leaf_rows", [4, 40, 100_000])
def test_holes_beyond_the_ring_and_over_each_other(spark, leaf_rows):
    rng = np.random.default_rng(9)
    polygons = [
        (1, square(0.0, 0.0, 8.0), [square(6.0, 6.0, 4.0), square(-2.0, 3.0, 3.0)], "A"),  # holes that stick out of the ring
        (2, square(0.0, 0.0, 8.0), [square(2.0, 2.0, 3.0), square(3.0, 3.0, 3.0), square(3.5, 3.5, 0.5)], "B"),  # holes over each other
        (3, square(-4.0, -4.0, 16.0), [square(0.0, 0.0, 4.0), square(0.0, 4.0, 4.0)], "C"),  # holes that share a border, which is also one of leaves
        (4, square(0.0, 0.0, 2.0), [square(20.0, 20.0, 3.0)], "D"),  # a hole elsewhere
        (5, square(1.0, 1.0, 2.0), [square(0.0, 0.0, 9.0)], "E"),  # a hole around the ring
    ]
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-5, 13, (400, 2)))]
    pts += [(900, 9.0, 9.0), (901, 3.7, 3.7), (902, 3.2, 3.2), (903, -1.0, 4.0), (904, 21.0, 21.0), (905, 2.0, 2.5)]
    got = spatial_matches(points(spark, pts), points(spark, []), spark.createDataFrame(polygons, POLYGON), 1.0, leaf_rows=leaf_rows)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(pts, [], polygons, 1.0)


def test_many_points_and_places_on_one_spot(spark, monkeypatch):
    monkeypatch.setattr("framelake.operators.spatial_join.PART_PAIRS", 500)
    pts, places = [(i, 5.0, 5.0) for i in range(150)], [(i, 5.0, 5.001) for i in range(40)]
    rows = [tuple(r) for r in spatial_matches(points(spark, pts), points(spark, places), spark.createDataFrame([], POLYGON), 1.0).collect()]
    assert len(rows) == len(set(rows)) == 150 * 40


def test_contains_without_ring():
    assert not contains(np.array([1.0]), np.array([1.0]), polygon_edges(None, [[{"lat": 0.0, "lon": 0.0}]])).any()


def test_empty_tables(spark):
    none, polygons = points(spark, []), spark.createDataFrame([], POLYGON)
    some = points(spark, [(1, 10.0, 10.0)])
    assert spatial_matches(none, none, polygons, 2.0).count() == 0
    assert spatial_matches(some, none, polygons, 2.0).count() == 0
    assert [tuple(r) for r in spatial_matches(some, some, polygons, 2.0).collect()] == [(1, "near", 1)]


def test_quadtree_partitions_the_domain():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-180, 180, 500), rng.uniform(-90, 90, 500)
    tree = QuadTree.fit(x, y, 20, (-180.0, -90.0, 180.0, 90.0))
    leaf = tree.locate(x, y)
    assert np.bincount(leaf).max() <= 20
    b = tree.leaf_boxes[leaf]
    assert ((b[:, 0] <= x) & (x <= b[:, 2]) & (b[:, 1] <= y) & (y <= b[:, 3])).all()
    item, found = tree.overlapping(np.column_stack([x, y, x, y]))
    assert {(i, n) for i, n in enumerate(leaf)} <= set(zip(item.tolist(), found.tolist()))


@pytest.mark.parametrize("n", [0, 1, 17, 400])
def test_rtree_finds_all(n):
    rng = np.random.default_rng(n)
    low = rng.uniform(0, 10, (n, 2))
    boxes = np.hstack([low, low + rng.uniform(0, 2, (n, 2))])
    x, y = rng.uniform(0, 12, 50), rng.uniform(0, 12, 50)
    got = {(int(p), int(i)) for ps, items in RTree(boxes).probe(x, y) for p, i in zip(ps, items)}
    want = {(p, i) for p in range(50) for i in range(n) if boxes[i, 0] <= x[p] <= boxes[i, 2] and boxes[i, 1] <= y[p] <= boxes[i, 3]}
    assert got == want


def test_disk_boxes_cover_disks():
    rng = np.random.default_rng(2)
    lat, lon = np.array([0.0, 60.0, 89.99, -89.99, 10.0]), np.array([0.0, 179.999, 30.0, -60.0, -180.0])
    item, box = disk_boxes(lat, lon, 5.0)
    for i in range(5):
        py, px = lat[i] + rng.uniform(-0.1, 0.1, 4000), lon[i] + rng.uniform(-180, 180, 4000) * (0.001 if abs(lat[i]) < 80 else 1)
        px = (px + 180) % 360 - 180
        hit = (np.abs(py) <= 90) & (haversine_km(lat[i], lon[i], py, px) <= 5.0)
        held = np.zeros(4000, bool)
        for b in box[item == i]:
            held |= (b[0] <= px) & (px <= b[2]) & (b[1] <= py) & (py <= b[3])
        assert hit.any() and (held | ~hit).all()
