import json
import os
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framelake.sources import exif, files, gazetteer, logs, sidecars, sinks
from framelake.streaming import incremental


def jpeg(make="Canon", date="2023:06:15 14:30:00", lat=(48, 51, 23.76), lat_ref="N", lon=(2, 21, 7.92), lon_ref="E"):
    """A JPEG header with an EXIF segment."""
    heap, entries_at = b"", 8

    def ifd(entries, base):
        nonlocal heap
        out, extra, at = struct.pack("<H", len(entries)), b"", base + 2 + 12 * len(entries) + 4
        for tag, kind, count, raw in entries:
            if len(raw) <= 4:
                out += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                out += struct.pack("<HHII", tag, kind, count, at + len(extra))
                extra += raw
        return out + b"\0\0\0\0" + extra

    text = lambda s: s.encode() + b"\0"
    ratio = lambda v: b"".join(struct.pack("<II", round(x * 100), 100) for x in v)
    main = lambda e, g: ifd([(exif.MAKE, 2, len(make) + 1, text(make)), (exif.EXIF_IFD, 4, 1, struct.pack("<I", e)), (exif.GPS_IFD, 4, 1, struct.pack("<I", g))], entries_at)
    e_at = entries_at + len(main(0, 0))
    e = ifd([(exif.ORIGINAL, 2, 20, text(date))], e_at)
    g_at = e_at + len(e)
    g = ifd([(1, 2, 2, text(lat_ref)), (2, 5, 3, ratio(lat)), (3, 2, 2, text(lon_ref)), (4, 5, 3, ratio(lon))], g_at)
    tiff = b"II*\0" + struct.pack("<I", 8) + main(e_at, g_at) + e + g
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\0"


def test_exif():
    got = exif.read_metadata(jpeg())
    assert got["taken"] == datetime(2023, 6, 15, 14, 30) and got["make"] == "Canon" and abs(got["lat"] - 48.8566) < 1e-6 and abs(got["lon"] - 2.3522) < 1e-6
    assert exif.read_metadata(jpeg(lat_ref="S"))["lat"] < 0 and exif.read_metadata(jpeg(lat=(0, 0, 0), lon=(0, 0, 0)))["lat"] is None
    assert exif.read_metadata(jpeg(date="broken"))["taken"] is None
    movie = b"\0\0\0\x14ftypqt  " + b"\0" * 8 + b"\xa9xyz\0\x12\x15\xc7+34.0522-118.2437/"
    assert (exif.read_metadata(movie)["lat"], exif.read_metadata(movie)["lon"]) == (34.0522, -118.2437)
    for junk in (None, b"", b"\xff\xd8", jpeg()[:60], b"II*\0\xff\xff\xff\xff", b"x" * 1000):
        assert set(exif.read_metadata(junk)) == set(exif.META.names)


PACKET = b"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
<rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:exif="http://ns.adobe.com/exif/1.0/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/"
 xmp:CreateDate="2021-02-03T04:05:06+01:00" exif:GPSLatitude="40,42.768N" exif:GPSLongitude="74,0,21.6W" photoshop:Album=" Summer "/></rdf:RDF></x:xmpmeta>"""


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def iptc(*values):
    body = b"".join(b"\x1c\x02" + struct.pack(">BH", n, len(v)) + v for n, v in values)
    return b"Photoshop 3.0\0" + b"8BIM" + struct.pack(">H", 0x03ED) + b"\0\0" + struct.pack(">I", 3) + b"abc\0" + b"8BIM" + struct.pack(">H", 0x0404) + b"\0\0" + struct.pack(">I", len(body)) + body


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def test_packets_and_records_in_jpeg():
    plain = b"\xff\xd8" + segment(0xE1, exif.JPEG_XMP + PACKET) + segment(0xED, iptc((20, b"Trip"), (120, b"Said"), (20, b"Later"))) + b"\xff\xda\0\0"
    got = exif.read_metadata(plain)
    assert got["taken"] == datetime(2021, 2, 3, 3, 5, 6) and abs(got["lat"] - 40.7128) < 1e-9 and abs(got["lon"] + 74.006) < 1e-9
    assert (got["album_xmp"], got["album_iptc"], got["description"]) == ("Summer", "Trip", "Said")
    both = exif.read_metadata(jpeg()[:-4] + plain[2:])
    assert both["taken"] == datetime(2023, 6, 15, 14, 30) and abs(both["lat"] - 48.8566) < 1e-6 and both["album_xmp"] == "Summer"


def test_png_and_heic():
    tiff = jpeg()[12:-4]
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + b"\0" * 4
    png = exif.PNG + chunk(b"IHDR", b"\0" * 13) + chunk(b"eXIf", tiff) + chunk(b"iTXt", exif.PNG_XMP + b"\0\0" + b"en\0title\0" + PACKET) + chunk(b"IEND", b"")
    got = exif.read_metadata(png)
    assert got["make"] == "Canon" and got["taken"] == datetime(2023, 6, 15, 14, 30) and got["album_xmp"] == "Summer"

    def heic(offset, version):
        count = struct.pack(">H", 2)
        infe = [box(b"infe", b"\x02\0\0\0" + struct.pack(">HH4s", i, 0, kind) + b"\0") for i, kind in ((1, b"hvc1"), (7, b"Exif"), (8, b"mime"))]
        items = [(7, offset, len(body)), (8, offset + len(body), len(PACKET))]
        sizes = b"\x44\x00"
        entries = b"".join(struct.pack(">H", i) + (b"\0\0" if version else b"") + struct.pack(">HHII", 0, 1, at, n) for i, at, n in items)
        meta = b"\0" * 4 + box(b"iinf", b"\0" * 4 + struct.pack(">H", 3) + b"".join(infe)) + box(b"iloc", bytes([version, 0, 0, 0]) + sizes + count + entries)
        return box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"meta", meta)

    body = struct.pack(">I", 6) + b"Exif\0\0" + tiff
    for version in (0, 1):
        head = heic(0, version)
        data = heic(len(head) + 8, version) + box(b"mdat", body + PACKET)
        got = exif.read_metadata(data)
        assert got["make"] == "Canon" and abs(got["lat"] - 48.8566) < 1e-6 and got["album_xmp"] == "Summer"
        for cut in range(0, len(data), 37):  # cut contents give less, never an error
            try:
                exif.read_metadata(data[:cut])
            except (struct.error, IndexError, ValueError, OverflowError):
                pass  # what the column function turns into nulls


def test_movies():
    header = box(b"mvhd", b"\0" * 4 + struct.pack(">I", int((datetime(2022, 5, 6, 7, 8, 9) - exif.MOVIE_EPOCH).total_seconds())) + b"\0" * 90)
    movie = box(b"ftyp", b"qt  \0\0\0\0") + box(b"moov", header)
    assert exif.read_metadata(movie)["taken"] == datetime(2022, 5, 6, 7, 8, 9) and exif.read_metadata(movie)["lat"] is None
    names = (exif.LOCATION_KEY, exif.DATE_KEY)
    keys = box(b"keys", b"\0" * 4 + struct.pack(">I", 2) + b"".join(box(b"mdta", n) for n in names))
    values = (b"+34.0522-118.2437+010.0/", b"2022-05-06T09:08:09+02:00")
    items = box(b"ilst", b"".join(box(struct.pack(">I", i), box(b"data", b"\0\0\0\x01\0\0\0\0" + v)) for i, v in enumerate(values, 1)))
    movie = box(b"ftyp", b"qt  \0\0\0\0") + box(b"mdat", b"x" * 50) + box(b"moov", box(b"mvhd", b"\0" * 98) + box(b"meta", keys + items))
    got = exif.read_metadata(movie)
    assert (got["lat"], got["lon"], got["taken"]) == (34.0522, -118.2437, datetime(2022, 5, 6, 7, 8, 9))


def test_intermediate_tables_are_cleaned(spark):
    from framelake import storage

    held = storage.write_table(spark.range(3), "test-clean")
    path = storage._made[spark.sparkContext.applicationId][-1]
    assert held.count() == 3 and storage.path_exists(spark, path)
    before = list(storage._made[spark.sparkContext.applicationId])
    storage._made[spark.sparkContext.applicationId][:] = [path]
    assert storage.clean(spark) == 1 and not storage.path_exists(spark, path)
    storage._made[spark.sparkContext.applicationId][:] = before[:-1]


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.jpg").write_bytes(jpeg())
    (tmp_path / "a" / "b" / "y.tar.gz").write_bytes(b"hello")
    (tmp_path / "z").write_bytes(b"z")
    (tmp_path / "empty").write_bytes(b"")
    rows = {r.name: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x.jpg", "y.tar.gz", "z", "empty"} and (rows["y.tar.gz"].stem, rows["y.tar.gz"].ext, rows["z"].ext) == ("y.tar", ".gz", "")
    assert rows["x.jpg"].dir == str(tmp_path / "a")
    assert {r.name for r in files.scan(spark, str(tmp_path), 2).collect()} == {"x.jpg", "z", "empty"}
    deep = files.with_metadata(files.with_checksum(files.scan(spark, str(tmp_path), content=True)))
    got = {r.name: (r.checksum[:8], r.meta.make) for r in deep.select("name", "checksum", "meta").collect()}
    assert got["y.tar.gz"] == ("2cf24dba", None) and got["x.jpg"][1] == "Canon"


def test_photo_json(spark):
    docs = [
        {"title": "t", "photoTakenTime": {"timestamp": "1686839400"}, "geoData": {"latitude": 48.8, "longitude": 2.3, "altitude": 35}}, {"creationTime": {"timestamp": 1686839400}, "geoData": {"latitude": 0.00001, "longitude": 0}, "geoDataExif": {"latitude": 1, "longitude": 2}},
        {"geoData": {"latitude": 0, "longitude": 0}}, {"description": "only"}, {},
    ]
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("not json",), (None,)], "t string").select(sidecars.photo_json(F.col("t")).alias("s")).collect()
    assert rows[0].s.taken == datetime(2023, 6, 15, 14, 30) and (rows[0].s.lat, rows[0].s.altitude, rows[0].s.title) == (48.8, 35.0, "t")
    assert rows[1].s.taken == datetime(2023, 6, 15, 14, 30) and (rows[1].s.lat, rows[1].s.lon) == (1.0, 2.0)
    assert all(r.s is None for r in rows[2:])


def test_xmp(spark):
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
    ns = 'xmlns:exif="http://ns.adobe.com/exif/1.0/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    full = f'{head}<rdf:Description {ns} exif:GPSLatitude="40,42.768N" exif:GPSAltitude="305/10"><exif:GPSLongitude>74,0.36W</exif:GPSLongitude><xmp:CreateDate>2023-06-15T14:30:00</xmp:CreateDate><dc:title><rdf:Alt><rdf:li xml:lang="de">Bild</rdf:li><rdf:li xml:lang="x-default">Picture</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>'
    lone = f'{head}<rdf:Description {ns} exif:GPSLatitude="40,42.768N"/></rdf:RDF></x:xmpmeta>'
    a, b, c, d = spark.createDataFrame([(full,), (lone,), ("<broken",), (None,)], "t string").select(sidecars.xmp(F.col("t")).alias("s")).select("s.*").collect()
    assert (round(a.lat, 4), round(a.lon, 3), a.altitude, a.title, a.taken) == (40.7128, -74.006, 30.5, "Picture", datetime(2023, 6, 15, 14, 30))
    assert b.lat is None and c.taken is None and d.title is None


def test_gazetteer(spark, tmp_path):
    good = "\t".join(["1", 'A "quoted', "a", "", "1.5", "2.5", "P", "PPL", "XA", "", "01", "", "", "", "77", "", "", "UTC", "2020-01-01"])
    (tmp_path / "p.txt").write_text("\n".join([good, good.replace("\tP\t", "\tH\t"), "short\tline", good.replace("1.5", "x"), good.replace("\t77\t", "\t\t")]))
    rows = gazetteer.read_places(spark, str(tmp_path / "p.txt")).collect()
    assert [(r.name, r.population) for r in rows] == [('A "quoted', 77), ('A "quoted', 0)]
    (tmp_path / "a.txt").write_text("# c\nUS.CA\tCalifornia\tx\nbad\n")
    assert [tuple(r) for r in gazetteer.read_admin1(spark, str(tmp_path / "a.txt")).collect()] == [("US", "CA", "California")]
    (tmp_path / "c.txt").write_text("#ISO\tx\nUS\tUSA\t840\tUS\tUnited States\nXX\n")
    assert [tuple(r) for r in gazetteer.read_countries(spark, str(tmp_path / "c.txt")).collect()] == [("US", "United States")]


def test_borders(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    geo = {"type": "FeatureCollection", "features": [
        {"properties": {"ISO_A2": "XA", "NAME": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring, ring[:2], ring]}},
        {"properties": {"ISO_A2": "-99", "ISO_A2_EH": "-99", "ADM0_A3": "XBC", "ADMIN": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring[:2]], [ring]]}},
    ]}
    (tmp_path / "b.json").write_text(json.dumps(geo))
    rows = gazetteer.read_borders(spark, str(tmp_path / "b.json")).orderBy("polygon_id").collect()
    assert [(r.country, r.name, len(r.ring), len(r.holes)) for r in rows] == [("XA", "A", 4, 1), ("XB", "B", 4, 0), ("XB", "B", 4, 0)]
    assert (rows[0].ring[1].lat, rows[0].ring[1].lon) == (0.0, 4.0)


def test_execute_and_logs(spark, tmp_path):
    src, dst = tmp_path / "s", tmp_path / "d"
    src.mkdir()
    for i in range(4):
        (src / f"f{i}").write_text("x" * (i + 1))
    rows = [(i, f"{src}/f{i}", f"{dst}/k/f{i}", i + 1) for i in range(4)] + [(9, f"{src}/none", f"{dst}/none", 1), (10, f"{src}/f0", f"{dst}/../e", 1)]
    plan = spark.createDataFrame(rows, "file_index bigint, path string, resolved string, length bigint")
    dry = {r.file_index: r.result for r in sinks.execute(plan, str(dst)).collect()}
    assert dry[0] == dry[9] == "Planned" and dry[10] == "Failed" and not dst.exists()
    done = sinks.execute(plan, str(dst), dry_run=False)
    got = {r.file_index: r.result for r in done.collect()}
    assert [got[i] for i in range(4)] == ["Completed"] * 4 and got[9] == got[10] == "Failed" and sorted(os.listdir(dst / "k")) == ["f0", "f1", "f2", "f3"]
    assert {r.result for r in sinks.execute(plan.limit(4), str(dst), dry_run=False).collect()} == {"Completed"}  # running again is harmless
    moved = spark.createDataFrame([(0, f"{dst}/k/f0", f"{dst}/m/f0", 1)], plan.schema)
    assert sinks.execute(moved, str(dst), move=True, dry_run=False).first().result == "Completed" and not (dst / "k" / "f0").exists()
    ops = plan.select(F.lit("run1").alias("session"), F.col("file_index").alias("seq"), "file_index", F.lit("Copy").alias("operation"), F.lit("Completed").alias("result"), F.col("path").alias("source_path"), F.col("resolved").alias("destination_path"), F.col("length").alias("file_size"), F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("timestamp").alias("ts"))
    logs.append_operations(ops, str(tmp_path / "ops"))
    assert logs.read_operations(spark, str(tmp_path / "ops"), "run1").count() == 6
    (tmp_path / "logs").mkdir()
    for name, text in (("a.json", '{"id": "a", "started": "2024-01-01T00:00:00Z"}'), ("b.json", '{"id": "b", "started": "2024-02-01T00:00:00Z"}'), ("c.json", "{broken")):
        (tmp_path / "logs" / name).write_text(text)
    assert [r.id for r in logs.read_logs(spark, str(tmp_path / "logs")).collect()] == ["b", "a"]


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError(11, "again")
        return "done"

    assert sinks.with_retries(flaky, pause=0) == "done"
    with pytest.raises(FileNotFoundError):
        sinks.with_retries(lambda: open("/nonexistent/file"), pause=0)


def test_stream_drops_redeliveries_and_resumes(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "file_id bigint, seen_at timestamp, length bigint, ext string"

    def deliver(ids, day):
        spark.createDataFrame([(i, datetime(2024, 1, day), 1, ".jpg") for i in ids], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = incremental.without_redeliveries(incremental.file_stream(spark, source, spark.createDataFrame([], schema).schema))
        incremental.run_to_folder(stream, out, mark).awaitTermination(120)

    deliver([1, 2, 2], 1)
    run()
    deliver([2, 3], 2)
    run()
    assert sorted(r.file_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    counted = incremental.windowed_counts(spark.read.parquet(source), "ext")
    assert sorted((r.n, r.bytes) for r in counted.collect()) == [(2, 2), (3, 3)]
