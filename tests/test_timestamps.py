from datetime import datetime

import pytest

from framelake.operators.timestamps import extend_dictionary, normalise, normalised_records, with_instants, written_instants
from framelake.storage import new_path

B = "Europe/Berlin"


@pytest.mark.parametrize(
    "text, zone, day_first, want",
    [
        ("2021-07-01T12:00:00Z", None, None, "2021-07-01T12:00:00.000000Z"), ("2021-07-01T12:00:00", B, False, "2021-07-01T10:00:00.000000Z"), ("2021-07-01T12:00:00", None, False, "unzoned"),
        ("2021:07:01 12:00:00.1234567", B, None, "2021-07-01T10:00:00.123456Z"), ("2021-07-01T12:00:00+0530", B, None, "2021-07-01T06:30:00.000000Z"), ("2021:07:01 12:00:00+02", None, None, "2021-07-01T10:00:00.000000Z"),
        ("2021-07-01 12:00:00 -0330", None, None, "2021-07-01T15:30:00.000000Z"), ("2021-07-01 12:00:00.5 UTC", None, None, "2021-07-01T12:00:00.500000Z"), ("2021-07-01 12:00:00 GMT", B, None, "2021-07-01T12:00:00.000000Z"),
        ("Fri, 01 Dec 2017 12:55:18 +1100", None, None, "2017-12-01T01:55:18.000000Z"), ("01 Dec 2017 12:55:18", B, None, "2017-12-01T11:55:18.000000Z"), ("December 1, 2017 12:55:18 am", "UTC", None, "2017-12-01T00:55:18.000000Z"),
        ("01/02/2020 10:00:00", "UTC", True, "2020-02-01T10:00:00.000000Z"), ("01/02/2020 10:00:00", "UTC", False, "2020-01-02T10:00:00.000000Z"), ("01/02/2020 10:00:00", "UTC", None, "2020-01-02T10:00:00.000000Z"),
        ("13/02/2020 10:00:00", "UTC", False, "unreadable"), ("31.12.2017 23:45", "UTC", True, "2017-12-31T23:45:00.000000Z"), ("1/2/2020 1:05:06 PM", "UTC", False, "2020-01-02T13:05:06.000000Z"), ("1/2/2020 13:05:06 PM", "UTC", False, "unreadable"),
        ("20110103_153727", "UTC", None, "2011-01-03T15:37:27.000000Z"), ("20110102T015654Z", None, None, "2011-01-02T01:56:54.000000Z"), ("1294151761", None, None, "2011-01-04T14:36:01.000000Z"), ("1294151761123", None, None, "2011-01-04T14:36:01.123000Z"),
        ("1294151761123456", None, None, "2011-01-04T14:36:01.123456Z"), ("/Date(1294151761123)/", None, None, "2011-01-04T14:36:01.123000Z"), ("/Date(1294151761123", None, None, "unreadable"), ("12941517611", None, None, "unreadable"),
        ("2021-03-28T02:30:00", B, None, "nonexistent"), ("2021-10-31T02:30:00", B, None, "ambiguous"), ("2021-10-31T02:30:00+02:00", B, None, "2021-10-31T00:30:00.000000Z"), ("2021-10-31T02:30:00+01:00[Europe/Berlin]", None, None, "2021-10-31T01:30:00.000000Z"),
        ("02 Oct 2014 00:02:10 Europe/Berlin", None, None, "2014-10-01T22:02:10.000000Z"), ("02 Oct 2014 00:02:10 Nowhere/Land", B, None, "unreadable"), ("2021-10-03T02:15:00", "Australia/Lord_Howe", None, "nonexistent"),
        ("2021-04-04T01:45:00", "Australia/Lord_Howe", None, "ambiguous"), ("2021-07-01T12:00:00", "Not/AZone", None, "unzoned"), ("0000:00:00 00:00:00", B, None, "unreadable"), ("0001-01-01T00:00:00", None, None, "unreadable"),
        ("2021-02-30T10:00:00Z", None, None, "unreadable"), ("2021-02-03T25:00:00", None, None, "unreadable"), ("around 2012", B, None, "unreadable"), ("  2021-07-01T12:00:00Z ", None, None, "2021-07-01T12:00:00.000000Z"), ("", None, None, "unreadable"),
        ("x" * 100_000, None, None, "unreadable"), ("2021-07-01", "UTC", None, "2021-07-01T00:00:00.000000Z"),
    ],
)
def test_normalise(text, zone, day_first, want):
    assert normalise(text, zone, day_first) == want


RESULTS = "result_id bigint, scan_id bigint, date_time string, utc_text string, increment int"
SNAPSHOTS = "snapshot_id bigint, scan_id bigint, earliest_date string"
RUNS = "scan_id bigint, zone_id string, day_first boolean"


def frames(spark, results, snapshots):
    runs = spark.createDataFrame([(1, B, True), (2, None, None), (2, None, None), (None, B, True)], RUNS)
    return spark.createDataFrame([(*r, "clash", 0) for r in results], RESULTS), spark.createDataFrame(snapshots, SNAPSHOTS), runs


def test_records(spark):
    results = [(1, 1, "2021-07-01 12:00"), (1, 1, "2021-07-01 12:00"), (2, 2, "2021-07-01 12:00"), (3, None, "01.02.2020 10:00"), (4, 9, "1294151761"), (5, 1, None), (6, 1, "   "), (7, 1, ""), (None, 1, "1294151761"), (8, 1, "01.02.2020 10:00")]
    results += [(100 + i, 1, "2021-10-31 02:30") for i in range(2000)]  # one text holds most rows
    got = {(r.record_kind, r.record_id): r.utc_text for r in normalised_records(spark, *frames(spark, results, [(1, 1, "2021-07-01 12:00"), (2, 2, "never")])).collect()}
    assert len(got) == 2000 + 7
    assert got[("scan_result", 1)] == "2021-07-01T10:00:00.000000Z" == got[("snapshot", 1)]
    assert got[("scan_result", 2)] == got[("scan_result", 3)] == "unzoned"
    assert got[("scan_result", 8)] == "2020-02-01T09:00:00.000000Z" and got[("scan_result", 150)] == "ambiguous" and got[("snapshot", 2)] == "unreadable"


def test_empty(spark):
    assert normalised_records(spark, *frames(spark, [], [])).count() == 0


def test_dictionary_grows_by_what_is_new(spark):
    path = new_path(spark, "test-dictionary")
    first, snapshots, runs = frames(spark, [(1, 1, "2021-07-01 12:00"), (2, 1, "x")], [])
    second = frames(spark, [(3, 1, "2021-07-01 12:00"), (4, 1, "y"), (5, 2, "x")], [])[0]
    a = written_instants(first, runs, "scan_result", "result_id", "date_time")
    b = written_instants(second, runs, "scan_result", "result_id", "date_time")
    assert extend_dictionary(spark, path, a, 0).count() == 2
    for _ in range(2):  # the same increment again changes nothing
        grown = extend_dictionary(spark, path, b, 1)
        assert sorted((r.text, r.increment) for r in grown.collect()) == [("2021-07-01 12:00", 0), ("x", 0), ("x", 1), ("y", 1)]
    assert with_instants(b, grown).where("utc_text is null").count() == 0
    assert isinstance(datetime.now(), datetime)
