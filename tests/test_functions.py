import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framelake.functions import coordinates, geo, text, times


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


@pytest.mark.parametrize(
    "casing, want",
    [
        ("original", "new york-cityHall"), ("lower", "new york-cityhall"), ("upper", "NEW YORK-CITYHALL"), ("title", "New York City Hall"), ("pascal", "NewYorkCityHall"),
        ("camel", "newYorkCityHall"), ("snake", "new_york_city_hall"), ("kebab", "new-york-city-hall"), ("screaming_snake", "NEW_YORK_CITY_HALL"),
    ],
)
def test_casing(spark, casing, want):
    assert values(spark, ["new york-cityHall", "", None], text.apply_casing(F.col("x"), casing)) == [want, "", None]


def test_unknown_casing():
    with pytest.raises(ValueError):
        text.apply_casing(F.lit("x"), "wavy")


def test_sanitize(spark):
    rows = ["a/b:c", "  x. ", "con", "COM1.txt", "CONSOLE", "a\x01b", "...", "", None, "  ", "ok"]
    assert values(spark, rows, text.sanitize_segment(F.col("x"))) == ["a_b_c", "x", "con_", "COM1.txt_", "CONSOLE", "a_b", "", "", "", "", "ok"]
    assert values(spark, ["a?", "", None], text.sanitize_or(F.col("x"), F.lit("F"))) == ["a_", "F", "F"]
    assert values(spark, ["a?", "b", None], text.has_invalid_chars(F.col("x"))) == [True, False, False]


def test_bytes(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1048576, 1572864, -2048, 5 * 1024**4, 1024**5]
    assert values(spark, sizes, text.format_bytes(F.col("x")), "x bigint") == ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "1.5 MB", "-2 KB", "5 TB", "1024 TB"]
    assert values(spark, [0, 1023, 1536, 1024**5, -1], text.format_bytes_report(F.col("x")), "x bigint") == ["0 B", "1,023 B", "1.5 KB", "1.0 PB", "0 B"]


def test_names_and_durations(spark):
    assert values(spark, ["a.b.jpg", "noext", ".hidden"], F.struct(text.file_stem(F.col("x")), text.file_extension(F.col("x")))) == [("a.b", ".jpg"), ("noext", ""), ("", ".hidden")]
    assert values(spark, [5, 65, 3725], text.format_duration(F.col("x")), "x bigint") == ["5s", "1m 05s", "1h 02m"]
    assert values(spark, ["short", "x" * 40], text.truncate_name(F.col("x"))) == ["short", "..." + "x" * 27]
    assert values(spark, ["NoGpsData", "odd", None], text.reason_code(F.col("x"))) == ["NO-GPS", "UNKNOWN", "UNKNOWN"]


@pytest.mark.parametrize("written, span", [("+2:00", timedelta(hours=2)), ("-1d", timedelta(days=-1)), ("+1d2:30", timedelta(days=1, hours=2, minutes=30)), ("-0:45", timedelta(minutes=-45))])
def test_offsets(spark, written, span):
    assert times.parse_offset(written) == span and times.format_offset(span) == written
    assert values(spark, [written], times.offset_interval(F.col("x"))) == [span]


@pytest.mark.parametrize("written", ["2:00", "+", "+24:00", "+1:60", "+1h", "", "+1:2"])
def test_bad_offsets(spark, written):
    with pytest.raises(ValueError):
        times.parse_offset(written)
    assert values(spark, [written], times.offset_interval(F.col("x"))) == [None]


def test_zones(spark):
    assert values(spark, [3.75, 11.25, -3.75, 180.0, 7.4], times.longitude_offset_hours(F.col("x")), "x double") == [0.0, 1.0, 0.0, 12.0, 0.5]
    ts = F.lit(datetime(2024, 1, 1, 12)).cast("timestamp")
    assert values(spark, [30.0, None], F.date_format(times.in_zone(ts, "gps", lon=F.col("x")), "HH:mm"), "x double") == ["14:00", "12:00"]
    assert values(spark, [1.0], F.date_format(times.in_zone(ts, "local", "Asia/Tokyo"), "HH:mm"), "x double") == ["21:00"]
    got = values(spark, ["2023:06:15 14:30:00", "2023-06-15T14:30:00", "2023-06-15T14:30:00+02:00", "June"], F.date_format(times.sidecar_date(F.col("x")), "yyyy-MM-dd HH:mm"))
    assert got == ["2023-06-15 14:30", "2023-06-15 14:30", "2023-06-15 12:30", None]


def test_written_coordinates(spark):
    rows = ["+48.8584+002.2945/", "-33.8688+151.2093+010.5/", "+00.0+000.0/", "+91+010/", "+48.8/", "48.8+2.2/", "", None, "+a+b/"]
    assert values(spark, rows, coordinates.iso6709(F.col("x"))) == [(48.8584, 2.2945), (-33.8688, 151.2093), None, None, None, None, None, None, None]
    lat = values(spark, ["40,42.768N", "40,42,46.08n", "40.7128", "-40.5", "40,1.0E", "91", "x", None], coordinates.xmp_coordinate(F.col("x"), False))
    assert [v if v is None else round(v, 6) for v in lat] == [40.7128, 40.7128, 40.7128, -40.5, None, None, None, None]
    assert values(spark, ["74,0.36W"], F.round(coordinates.xmp_coordinate(F.col("x"), True), 6)) == [-74.006]
    assert values(spark, ["305/10", "10/0", "12.5", "/2", "a/b", None], coordinates.xmp_altitude(F.col("x"))) == [30.5, None, 12.5, None, None, None]


@pytest.mark.parametrize("lat, lon, cell", [(40.7128, -74.0060, "dr5r"), (51.5074, -0.1278, "gcpv"), (35.6762, 139.6503, "xn76"), (-33.8688, 151.2093, "r3gx"), (0.0, 0.0, "s000")])
def test_geohash_vectors(spark, lat, lon, cell):
    assert values(spark, [(lat, lon)], geo.geohash(F.col("a"), F.col("b"), 4), "a double, b double") == [cell]


def test_geohash_against_bisection(spark):
    def bisect(lat, lon, precision):
        box, out, bits = [[-180.0, 180.0], [-90.0, 90.0]], "", 0
        for i in range(5 * precision):
            axis, value = (box[0], lon) if i % 2 == 0 else (box[1], lat)
            mid = sum(axis) / 2
            bits = bits * 2 + (value >= mid)
            axis[not value >= mid] = mid
            if i % 5 == 4:
                out, bits = out + geo.ALPHABET[bits], 0
        return out

    import random

    rng = random.Random(1)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 180.0)]
    for precision in (1, 5, 8):
        got = values(spark, points, geo.geohash(F.col("a"), F.col("b"), precision), "a double, b double")
        assert got == [bisect(a, b, precision) for a, b in points]


def test_cells(spark):
    n = values(spark, [(0, 512)], F.size(geo.neighbour_cells(F.col("a"), F.col("b"), 4)), "a bigint, b bigint")
    top = values(spark, [(0, 1023)], geo.neighbour_cells(F.col("a"), F.col("b"), 4), "a bigint, b bigint")[0]
    assert n == [9] and len(top) == 6 and {c.x for c in top} == {1023, 0, 1}
    assert values(spark, ["dr5rg", "d", ""], geo.ancestors(F.col("x"))) == [["d", "dr", "dr5", "dr5r"], [], []]


def test_distances(spark):
    d = geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    got = values(spark, [(51.5074, -0.1278, 48.8566, 2.3522), (10.0, 10.0, 10.0, 10.0), (0.0, 0.0, 0.0, 180.0)], d, "a double, b double, c double, d double")
    assert abs(got[0] - 344) < 1 and got[1] == 0 and abs(got[2] - math.pi * 6371) < 1e-6
    assert values(spark, [190.0, -190.0, 180.0, 540.0], geo.normalise_longitude(F.col("x")), "x double") == [-170.0, 170.0, 180.0, -180.0]


SHAPE = "ring array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>, lat double, lon double"


def test_polygons(spark):
    square, hole = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)], [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)]
    rows = [(square, [hole], 5.0, 5.0), (square, [hole], 2.0, 2.0), (square, [], 5.0, 5.0), (square, None, 11.0, 5.0), ([*square, square[0]], None, 5.0, 1.0), (square[:2], None, 0.0, 5.0), (square[::-1], [], 5.0, 5.0)]
    df = spark.createDataFrame(rows, SHAPE)
    got = [r[0] for r in df.select(geo.point_in_polygon(F.col("lat"), F.col("lon"), F.col("ring"), F.col("holes"))).collect()]
    assert got == [False, True, True, False, True, False, True]
    edge = spark.createDataFrame([(square, None, 0.00005, 5.0), (square, None, 0.001, 5.0), (square, None, 10.00005, 10.0)], SHAPE)
    assert [r[0] for r in edge.select(geo.on_edge(F.col("lat"), F.col("lon"), F.col("ring"))).collect()] == [True, False, True]
    box = df.select(geo.bounding_box(F.col("ring")).alias("b")).first().b
    assert (box.min_lat, box.min_lon, box.max_lat, box.max_lon) == (0, 0, 10, 10)


def test_place_kinds(spark):
    rows = [("PPLC", 1), ("PPLA2", None), ("PPLX", 10**6), ("PPLL", 10**6), ("PPL", 10**5), ("PPL", 10**4), ("PPL", 9), ("PPL", None)]
    assert values(spark, rows, geo.place_type(F.col("c"), F.col("p")), "c string, p bigint") == [5, 4, 0, 1, 3, 2, 1, 1]
    assert values(spark, ["PPLC", "PPLA3", "PPL", "PPLF", "PPLX", "PPLL", "ADM1"], geo.feature_priority(F.col("x"))) == [100, 80, 60, 50, 40, 20, 10]
