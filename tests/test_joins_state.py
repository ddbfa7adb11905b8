from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framelake.operators import geocode, joins, regions, reports, state
from framelake.operators.enrich import album_name, camera_name, merge_sidecar
from framelake.operators.lookup import lookup_join

T = datetime(2023, 6, 1, 12)


def test_nearest_position(spark):
    rows = [
        (1, T, 1.0, 1.0, False), (2, T + timedelta(minutes=10), 2.0, 2.0, False), (3, T + timedelta(minutes=5), None, None, True), (4, T + timedelta(minutes=4), None, None, True),
        (5, T + timedelta(minutes=40), None, None, True), (6, T + timedelta(minutes=41), None, None, True), (7, None, None, None, True), (8, T, 3.0, 3.0, False), (9, T, None, None, True), (10, T - timedelta(minutes=30), None, None, True),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, ts timestamp, lat double, lon double, needs_position boolean")
    got = {r.file_id: r.from_id for r in joins.nearest_position(df, 30).collect()}
    assert got == {3: 2, 4: 1, 5: 2, 9: 1, 10: 1}  # 3 is a tie: the later one; 9: equal times, the smaller id
    assert joins.nearest_position(df, 0).count() == joins.nearest_position(df, None).count() == 0
    assert joins.nearest_position(df.limit(0), 30).count() == 0


def test_nearest_position_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = [(i, T + timedelta(seconds=rng.randrange(20_000)), 1.0 if rng.random() < 0.3 else None, 1.0, rng.random() < 0.7) for i in range(400)]
    df = spark.createDataFrame([(a, b, c, d if c else None, e and c is None) for a, b, c, d, e in rows], "file_id bigint, ts timestamp, lat double, lon double, needs_position boolean")
    have = [(a, b) for a, b, c, *_ in rows if c]
    want = {}
    for a, b, c, _, e in rows:
        near = [(abs(t - b), -(t - T), i) for i, t in have if abs(t - b) <= timedelta(minutes=5)]
        if e and c is None and near:
            want[a] = min(near)[2]
    assert {r.file_id: r.from_id for r in joins.nearest_position(df, 5).collect()} == want


LOC = "location struct<city:string>"


def test_live_pairs(spark):
    rows = [
        (1, "/a", "IMG_1", ".HEIC", "/a/IMG_1.HEIC", ("Rome",), "None", "taken"), (2, "/a", "img_1", ".mov", "/a/img_1.mov", None, "NoGpsData", "created"), (3, "/b", "IMG_1", ".mov", "/b/IMG_1.mov", None, "NoGpsData", "created"),
        (4, "/a", "IMG_1", ".jpg", "/a/IMG_1.JPG", None, "NoGpsData", "taken"), (5, "/a", "IMG_2", ".mov", "/a/IMG_2.mov", ("Oslo",), "None", "created"), (6, "/a", "IMG_2", ".jpg", "/a/IMG_2.jpg", ("Bern",), "None", "taken"), (7, "/a", "IMG_3", ".mp4", "/a/IMG_3.mp4", None, "NoGpsData", "taken"),
    ]
    df = spark.createDataFrame(rows, f"file_id bigint, dir string, stem string, ext string, path string, {LOC}, unknown_reason string, ts_source string")
    got = {r.file_id: (r.location.city if r.location else None, r.unknown_reason, r.paired_with) for r in joins.live_pairs(df).collect()}
    assert got[2] == ("Rome", "None", 1) and got[3] == (None, "NoGpsData", None) and got[5] == ("Oslo", "None", None) and len(got) == 7


def test_related(spark):
    names = ["photo.jpg", "photo.jpg.xmp", "photo_edit.jpg", "PHOTO.mov", "photos.jpg", "p.txt"]
    df = spark.createDataFrame([(i, f"/a/{n}", "/a", n, n.rpartition(".")[0]) for i, n in enumerate(names)], "file_id bigint, path string, dir string, name string, stem string")
    strict = {(r.main_id, r.related_id) for r in joins.related_files(df, "strict").collect()}
    assert {b for a, b in strict if a == 0} == {1, 2, 3}
    loose = {(r.main_id, r.related_id) for r in joins.related_files(df, "loose").collect()}
    assert {b for a, b in loose if a == 0} == {1, 2, 3, 4} and {b for a, b in loose if a == 5} == {0, 1, 2, 3, 4}
    assert joins.related_files(df, "none").count() == 0
    got = [r[0] for r in spark.createDataFrame([("photo.jpg", "/d/x/new.jpg", n) for n in ("photo.jpg.xmp", "photo_edit.png", "other.aae")], "m string, d string, r string").select(joins.related_destination(F.col("m"), F.col("d"), F.col("r"))).collect()]
    assert got == ["/d/x/new.jpg.xmp", "/d/x/new_edit.png", "/d/x/new.aae"]


def test_sidecars_and_duplicates(spark):
    files = spark.createDataFrame([(1, "/a", "x.jpg", "x"), (2, "/a", "y.jpg", "y")], "file_id bigint, dir string, name string, stem string")
    held = spark.createDataFrame([("/a", "X.XMP", "/a/X.XMP"), ("/a", "x.jpg.json", "/a/x.jpg.json"), ("/a", "y.jpg.json", "/a/y.jpg.json"), ("/a", "y.json", "/a/y.json")], "dir string, name string, path string")
    assert {r.file_id: r.sidecar_path for r in joins.sidecar_matches(files, held).collect()} == {1: "/a/X.XMP", 2: "/a/y.jpg.json"}
    d = spark.createDataFrame([(1, "/a", "AB"), (2, "/b", "ab"), (3, "/c", None), (4, "/d", ""), (5, "/e", "cd")], "file_id bigint, path string, checksum string")
    assert sorted((r.checksum, r.n, r.first_path, r.path) for r in joins.duplicate_groups(d).collect()) == [("ab", 2, "/a", "/a"), ("ab", 2, "/a", "/b")]
    assert [(r.file_id, r.original) for r in joins.duplicate_of(d).collect()] == [(2, "/a")]


def test_camera_and_album(spark):
    rows = [("Canon", "EOS R5"), ("Canon", "canon EOS"), (" ", "X  1"), (None, None), ("A/B", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(camera_name(F.col("a"), F.col("b"))).collect()] == ["Canon EOS R5", "canon EOS", "X 1", None, "A_B"]
    rows = [("x", "i", "p", "d"), (" ", "i", None, None), (None, None, "p", None), (None, None, None, "ALBUM: Trip "), (None, None, None, "Album:"), (None, None, None, "text")]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string, c string, d string").select(album_name(*map(F.col, "abcd"))).collect()] == ["x", "i", "p", "Trip", None, None]


def test_sidecar_priority(spark):
    df = spark.createDataFrame([(1.0, 2.0, T, 5.0, 6.0, None), (None, None, None, 5.0, 6.0, T), (0.0, 0.0, None, None, None, None)], "lat double, lon double, taken timestamp, side_lat double, side_lon double, side_taken timestamp")
    assert [r.lat for r in merge_sidecar(df).collect()] == [1.0, 5.0, 0.0]
    assert [r.lat for r in merge_sidecar(df, "sidecar_first").collect()] == [5.0, 5.0, 0.0]


PLACE = "place_id bigint, name string, lat double, lon double, feature_class string, feature_code string, country string, admin1 string, population bigint"


def places(spark):
    rows = [(1, "Big", 50.0, 14.0, "P", "PPLC", "XA", "1", 10**6), (2, "Hamlet", 50.02, 14.02, "P", "PPL", "XB", "2", 10), (3, "Admin", 50.021, 14.021, "A", "ADM1", "XA", "1", 10**6), (4, "Null", None, 1.0, "P", "PPL", "XA", "1", 5), (5, "Zero", 0.0, 0.0, "P", "PPL", "XA", "1", 5)]
    return spark.createDataFrame(rows, PLACE)


def test_geocoding(spark):
    index = geocode.place_index(places(spark))
    assert index.count() == 2 and geocode.place_index(places(spark), minimum_population=100).count() == 1
    points = spark.createDataFrame([(50.021, 14.021), (50.021, 14.021), (0.0, 0.0), (None, 1.0), (80.0, 0.0)], "lat double, lon double")
    got = [(r.any_id, r.city_id, r.state, r.country) for r in geocode.nearest_places(points, index).collect()]
    assert got == [(2, 1, "2", "XB")]
    countries = spark.createDataFrame([(50.021, 14.021, "XA")], "lat double, lon double, country string")
    assert [(r.district, r.city, r.country) for r in geocode.reverse_geocode(points, index, countries=countries).collect()] == [("Big", "Big", "XA")]
    nowhere = countries.withColumn("country", F.lit("ZZ"))
    assert [(r.district, r.city) for r in geocode.reverse_geocode(points, index, countries=nowhere).collect()] == [("Hamlet", "Big")]
    stream = geocode.streamed_geocode(points, geocode.place_index(places(spark), classes=("P", "A")))
    assert [(r.any_id, r.city_id) for r in stream.collect()] == [(1, 1)]
    kept = {r.place_id for r in geocode.prune_nearby(index).collect()}
    assert kept == {1}


def test_regions(spark):
    square = lambda y, x, s: [(y, x), (y, x + s), (y + s, x + s), (y + s, x)]
    b = spark.createDataFrame([("XA", "A", 1, square(0.0, 0.0, 4.0), []), ("XB", "B", 2, square(2.0, 2.0, 4.0), [square(5.0, 5.0, 0.5)]), (None, "C", 3, [(0.0, 0.0)], None)], "country string, name string, polygon_id int, ring array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>")
    points = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (5.2, 5.2), (50.0, 50.0), (None, 1.0)], "lat double, lon double")
    got = {r.lat: (r.country, r.candidates, r.is_ocean, r.is_border) for r in regions.country_lookup(points, b).collect()}
    assert got == {1.0: ("XA", ["XA"], False, False), 3.0: ("XA", ["XA", "XB"], False, True), 5.2: (None, [], True, False), 50.0: (None, [], True, False)}
    assert regions.edge_points(spark.createDataFrame([(0.00001, 2.0), (1.0, 1.0)], "lat double, lon double"), b).count() == 1
    assert regions.cell_countries(b).where("is_border").count() >= 1
    ring = [(0.0, 0.0), (0.0, 5.0), (0.001, 7.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
    assert regions.simplify_ring(ring) == [[0.0, 0.0], [0.0, 10.0], [10.0, 10.0], [10.0, 0.0], [0.0, 0.0]]
    assert regions.simplified(b).count() == 3


def test_edge_points_beyond_the_box(spark):
    cell = 180 / 128  # a side of the cells that edge_points joins on
    square = lambda y, x: [(y, x), (y, x + cell), (y + cell, x + cell), (y + cell, x)]
    b = spark.createDataFrame([("XA", 1, square(0.0, 0.0), []), ("XB", 2, square(20.0, -180.0), []), ("XC", 3, square(40.0, 180 - cell), [])], "country string, polygon_id int, ring array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>")
    near = [(1, -0.03, 1.0), (1, 1.0, -0.03), (1, 1.0, cell + 0.03), (1, cell + 0.03, 1.0), (2, 20.5, 179.98), (2, 20.5, 180.0), (3, 40.5, -179.98)]
    far = [(-0.06, 1.0), (1.0, -0.06), (20.5, 179.9), (40.5, -179.9), (0.7, 0.7)]
    points = spark.createDataFrame([(la, lo) for _, la, lo in near] + far, "lat double, lon double")
    assert sorted((r.polygon_id, r.lat, r.lon) for r in regions.edge_points(points, b, 0.05).collect()) == sorted(near)


SHAPE = "polygon_id int, country string, ring array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>"


def test_polygons_with_holes_by_cells(spark, tmp_path):
    import random

    rng = random.Random(2)
    square = lambda y, x, n: [(y, x), (y, x + n), (y + n, x + n), (y + n, x)]
    shapes = [
        (1, "A", square(0.0, 0.0, 9.0), [square(6.0, 6.0, 5.0), square(1.0, 1.0, 4.0), square(2.0, 2.0, 4.0)]), (2, "B", square(-20.0, -20.0, 50.0), None),
        (3, "C", [(0.0, 0.0), (1.0, 1.0)], []), (4, None, [(-5.0, 170.0), (5.0, 170.0), (5.0, 180.0), (-5.0, 180.0)], [[], None]), (5, "E", None, None),
    ]
    pts = [(rng.uniform(-12, 12), rng.uniform(-12, 12)) for _ in range(400)] + [(rng.uniform(-6, 6), rng.uniform(168, 180)) for _ in range(100)]

    def odd(y, x, ring):
        edges = zip(ring, ring[1:] + ring[:1], strict=True) if ring and len(ring) > 2 else []
        return sum((a[0] > y) != (b[0] > y) and x < a[1] + (b[1] - a[1]) * (y - a[0]) / (b[0] - a[0]) for a, b in edges) % 2 == 1

    want = {(y, x, p) for y, x in pts for p, _, ring, holes in shapes if odd(y, x, ring) and not any(odd(y, x, h) for h in holes or [])}
    b, points = spark.createDataFrame(shapes, SHAPE), spark.createDataFrame(pts, "lat double, lon double")
    for precision in (2, 3, 4):
        assert {(r.lat, r.lon, r.polygon_id) for r in regions.containing_polygons(points, b, precision).collect()} == want
    cells = regions.polygon_cells(b).collect()
    assert any(c.whole for c in cells) and max(len(c.edges or []) for c in cells) < 16
    regions.write_border_index(b, str(tmp_path / "borders"))
    held = regions.read_border_index(spark, str(tmp_path / "borders"))
    assert {(r.lat, r.lon, r.polygon_id) for r in regions.containing_polygons(points, held).collect()} == want
    assert regions.country_lookup(points, held).where("country = 'A'").count() == len({w[:2] for w in want if w[2] == 1})


def test_simplify_against_recursion():
    import random
    from math import hypot

    rng = random.Random(3)

    def gap(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        n = hypot(*d)
        return hypot(p[0] - a[0], p[1] - a[1]) if n == 0 else abs(d[0] * (p[1] - a[1]) - d[1] * (p[0] - a[0])) / n

    def slow(line):
        if len(line) < 3:
            return line
        far = max(range(1, len(line) - 1), key=lambda i: gap(line[i], line[0], line[-1]))
        return slow(line[: far + 1])[:-1] + slow(line[far:]) if gap(line[far], line[0], line[-1]) > 0.1 else [line[0], line[-1]]

    for n in (5, 9, 60):
        ring = [[rng.uniform(0, 1), rng.uniform(0, 1)] for _ in range(n)]
        ring.append(ring[0])
        assert regions.simplify_ring([tuple(p) for p in ring], 0.1) == slow(ring)


def test_prune_against_brute_force(spark):
    import math
    import random

    rng = random.Random(4)
    rows = [(i, f"n{i}", rng.uniform(0, 1), rng.uniform(0, 1), "P", rng.choice(["PPL", "PPLA", "PPLC", None]), "XA", "01", rng.choice([None, 0, 500, 20_000, 200_000])) for i in range(250)]
    places = spark.createDataFrame(rows, "place_id bigint, name string, lat double, lon double, feature_class string, feature_code string, country string, admin1 string, population bigint")
    index = geocode.place_index(places)

    def km(a, b):
        s = math.sin(math.radians(a[0] - b[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(s))

    cells = {}
    for r in sorted(index.collect(), key=lambda r: (-r.kind, -(r.population or 0), r.place_id)):
        kept = cells.setdefault((r.x, r.y), [])
        if all(km((r.place_lat, r.place_lon), k[1:]) > 5 for k in kept):
            kept.append((r.place_id, r.place_lat, r.place_lon))
    assert {r.place_id for r in geocode.prune_nearby(index).collect()} == {k[0] for kept in cells.values() for k in kept}


def test_nearest_place_of_the_whole_radius(spark):
    import math
    import random

    rng = random.Random(5)
    spots = [(rng.uniform(*rng.choice([(-1, 1), (59, 61), (88.8, 90), (-90, -89)])), rng.choice([rng.uniform(-2, 2), rng.uniform(178, 180), rng.uniform(-180, -178)])) for _ in range(160)]
    rows = [(i, f"n{i}", y, x, "P", "PPL", "XA", "01", 10) for i, (y, x) in enumerate(spots[:80])]
    places = spark.createDataFrame(rows, "place_id bigint, name string, lat double, lon double, feature_class string, feature_code string, country string, admin1 string, population bigint")

    def km(a, b):
        s = math.sin(math.radians(a[0] - b[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(s))

    got = {(r.lat, r.lon): r.any_id for r in geocode.nearest_places(spark.createDataFrame(spots[80:], "lat double, lon double"), geocode.place_index(places), ring=None).collect()}
    want = {p: d[1] for p in spots[80:] if (d := min((km(p, q), i) for i, q in enumerate(spots[:80])))[0] < 50}
    assert got == want and len(want) > 20


def test_running_progress_and_no_name_left(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else "b", None if i == 5 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "n bigint, batch string, size bigint")
    got = {r.n: (r.done, r.done_bytes, r.percent) for r in reports.running_progress(df, "batch", "n", "size").collect()}
    for n, batch, _ in rows:
        before = [r for r in rows if r[1] == batch and r[0] <= n]
        assert got[n][:2] == (len(before), sum(r[2] or 0 for r in before))
    assert got[299][2] == 100.0
    from framelake.operators import collisions

    monkeypatch.setattr(collisions, "MOST_NUMBERS", 3)
    clean = spark.createDataFrame([(f"{i}", "/d/a.jpg") for i in range(5)], "path string, destination string")
    dirty = clean.unionByName(spark.createDataFrame([("x", "/d/a-1.jpg")], "path string, destination string"))
    for plan in (clean, dirty):
        with pytest.raises(Exception, match="no free name for /d/a.jpg"):
            collisions.resolve_collisions(plan).collect()
    assert collisions.resolve_collisions(clean.limit(4)).count() == 4


def test_state(spark):
    ops = spark.createDataFrame([(0, "Completed", 5, T), (1, "Failed", 7, T), (2, "CopyDonePendingDelete", 9, T + timedelta(1)), (3, "Skipped", 1, None)], "file_index int, result string, file_size bigint, ts timestamp")
    plan = spark.createDataFrame([(i,) for i in range(5)], "file_index int")
    assert {r.file_index for r in state.pending(plan, ops).collect()} == {1, 3, 4}
    s = state.checkpoint_statistics(ops).first()
    assert (s.completed, s.failed, s.skipped, s.bytes_done) == (2, 1, 1, 14) and state.checkpoint_statistics(ops.limit(0)).first().bytes_done == 0
    a = spark.createDataFrame([("/A", 1), ("/b", None)], "path string, length bigint")
    h = lambda df: state.plan_hash(df).first().hash
    assert h(a) == h(a.orderBy(F.desc("path"))) == h(a.withColumn("path", F.lower("path"))) != h(a.withColumn("length", F.lit(2)))
    log = spark.createDataFrame([(1, "Move", "/s/a", "/d/a"), (2, "Copy", "/s/b", "/d/b"), (3, "Move", "/s/c", "/d/../c"), (4, "Copy", "/s", None)], "seq bigint, operation string, source_path string, destination_path string")
    assert [(r.action, r.to_path) for r in state.inverse_operations(log).collect()] == [("invalid", None), ("invalid", None), ("delete", None), ("move_back", "/s/a")]
    dirs = spark.createDataFrame([("/d",), ("/d/e",), ("/d",)], "dir string")
    assert [r.dir for r in state.directories_to_remove(dirs).collect()] == ["/d/e", "/d"]
    c = {"source": "/a/", "destination": "/b", "config_hash": "h", "started": T, "completed": 3}
    assert state.checkpoint_problems(c, "/a", "/b", "h", T, 4) == ([], [])
    assert len(state.checkpoint_problems(c, "/x", "/y", "z", T + timedelta(40), 3)[0]) == 4
    assert [state.resume_decision(*x) for x in ((True, c, [], True), (False, None, [], True), (False, c, ["e"], True), (False, c, [], True), (False, c, [], False))] == ["fresh", "fresh", "invalid", "resume", "ask"]


def test_reports(spark):
    n = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "ext string, n bigint")
    assert [tuple(r) for r in reports.top_with_other(n, "ext", 2).orderBy(F.desc("n"), "ext").collect()] == [("a", 5, 41.7), ("(other)", 4, 33.3), ("b", 3, 25.0)]
    assert reports.top_with_other(n, "ext", 9).count() == 4 and reports.top_with_other(n.limit(0), "ext", 3).count() == 0


def test_lookup_join_broadcasts_only_what_is_small(spark):
    facts, dim = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    for bound in (1000, 10):
        joined = lookup_join(facts, dim, ["k"], broadcast_rows=bound)
        assert joined.where("v is null").count() == 50 and joined.count() == 100
    assert "BroadcastHashJoin" in lookup_join(facts, dim, ["k"])._jdf.queryExecution().executedPlan().toString()
