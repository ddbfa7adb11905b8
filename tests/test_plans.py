from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framelake.config import Settings, diagnose, edit_distance, load_settings, settings_hash, suggestion
from framelake.operators import collisions, filters, ranking
from framelake.operators.template import Variable, counted_levels, parse_template
from framelake.plans import organise

FILE = (
    "file_id bigint, path string, dir string, name string, stem string, ext string, length bigint, created timestamp, modified timestamp, taken timestamp, lat double, lon double, make string, model string, "
    "album_xmp string, album_iptc string, album_xp string, description string, location struct<district:string,city:string,county:string,state:string,country:string,population:bigint>, unknown_reason string, checksum string, seen_at timestamp, destination string"
)
T = datetime(2023, 6, 15, 14, 30)


def file(i, name="test.jpg", city=None, country=None, district=None, folder="/src", **kw):
    stem, dot, ext = name.rpartition(".")
    loc = (district, city, None, None, country, None) if city or country or district else None
    row = dict(file_id=i, path=f"{folder}/{name}", dir=folder, name=name, stem=stem or name, ext=dot + ext if stem else "", length=10, created=T, modified=T, taken=T, lat=None, lon=None, make=None, model=None, album_xmp=None)
    row |= dict(album_iptc=None, album_xp=None, description=None, location=loc, unknown_reason="None", checksum=None, seen_at=T, destination="clash")
    return tuple((row | kw).values())


def where(spark, files, template, **kw):
    rows = organise.destinations(spark.createDataFrame(files, FILE), Settings(source="/src", destination=template, **kw))
    return {r.file_id: r.destination for r in rows.collect()}


def test_thresholds_use_all_files_without_case(spark):
    files = [file(i, city="London" if i % 2 else "LONDON") for i in range(10)] + [file(20, city="Rye"), file(21)]
    got = where(spark, files, "/d/{year}/{city?min=10|Unknown}/{name}{ext}")
    assert got[1] == "/d/2023/London/test.jpg" and got[0] == "/d/2023/LONDON/test.jpg" and got[20] == got[21] == "/d/2023/Unknown/test.jpg"


def test_chain_with_conditions(spark):
    cities = ["Prague"] * 15 + ["Brno"] * 3
    files = [file(i, city=c, country="CZ") for i, c in enumerate(cities)] + [file(50 + i, city="Vienna", country="AT") for i in range(8)] + [file(90)]
    got = where(spark, files, "/d/{city?min=10|country?min=10|Misc}/{name}")
    assert (got[0], got[15], got[50], got[90]) == ("/d/Prague/test", "/d/CZ/test", "/d/Misc/test", "/d/Misc/test")
    got = where(spark, files, "/d/{city?min=2,max=5|}/{name}")
    assert (got[0], got[15]) == ("/d/test", "/d/Brno/test")
    got = where(spark, files, "/d/{city?min=100}/{name}")
    assert got[0] == "/d/Unknown/test"


def test_masks_casing_and_orphans(spark):
    f = [file(1, city="New York", country="US", district="Soho", make="Canon", model="EOS R5"), file(2, city="Prague"), file(3, district="Soho")]
    assert where(spark, f, "/d/{country}-{city}/{name}{ext}", unknown="")[2] == "/d/Prague/test.jpg"
    assert where(spark, f, "/d/{city}/{camera}/{filename}", casing="snake")[1] == "/d/new_york/canon_eos_r5/test.jpg"
    assert where(spark, f, "/d/{city}/x")[3] == "/d/Soho/x"
    assert where(spark, f, "/d/{city}/{country}", granularity="country")[1] == "/d/Unknown/US"
    assert where(spark, f, "/d/{camera}/{album}/{dayOfYear}", unknown_camera="NoCam")[2] == "/d/NoCam/Unknown/166"


def test_inserted_values_are_not_templates(spark):
    assert where(spark, [file(1, city="{country}", country="US")], "/d/{city}/x")[1] == "/d/{country}/x"


def test_directory_variable(spark):
    got = where(spark, [file(1, folder="/src/a/../b:c"), file(2), file(3, folder="/src/x/y")], "/d/{directory}/{name}{ext}")
    assert got == {1: "/d/a/b_c/test.jpg", 2: "/d/test.jpg", 3: "/d/x/y/test.jpg"}


def test_parse_template():
    parts = parse_template("/a/{city?min=3,max=9|country?min=2?max=4|Lit}/{bogus}")
    assert isinstance(parts[1], Variable) and [(x.name, x.least, x.most) for x in parts[1].links[:2]] == [("city", 3, 9), ("country", 2, 4)]
    assert parts[1].links[2].literal == "Lit" and parts[3].links[0].unknown
    assert counted_levels("/a/{city?min=3|state}/{county?max=2}") == ["city", "county"]


def test_collision_numbers(spark):
    def resolve(rows, existing=(), **kw):
        df = spark.createDataFrame([(p, d, "x") for p, d in rows], "path string, destination string, resolved_by string")
        held = spark.createDataFrame([(e,) for e in existing], "destination string")
        return {r.path: r.resolved for r in collisions.resolve_collisions(df, held, **kw).collect()}

    assert resolve([("1", "/d/A.jpg"), ("2", "/d/a.jpg"), ("3", "/d/a.jpg")]) == {"1": "/d/A.jpg", "2": "/d/a-1.jpg", "3": "/d/a-2.jpg"}
    assert resolve([("1", "/d/a.jpg"), ("2", "/d/a.jpg"), ("3", "/d/a-1.jpg")]) == {"1": "/d/a.jpg", "2": "/d/a-1.jpg", "3": "/d/a-1-1.jpg"}
    assert resolve([("1", "/d/a-1.jpg"), ("2", "/d/a.jpg"), ("3", "/d/a.jpg")]) == {"1": "/d/a-1.jpg", "2": "/d/a.jpg", "3": "/d/a-2.jpg"}
    assert resolve([("1", "/d/a.jpg"), ("2", "/d/b.jpg")], ["/d/A.jpg", "/d/a-1.jpg"]) == {"1": "/d/a-2.jpg", "2": "/d/b.jpg"}
    assert resolve([("1", "/d/a"), ("2", "/d/a")], form="_{number}") == {"1": "/d/a", "2": "/d/a_1"}
    assert resolve([("1", "/d/a"), ("2", "/d/a")], mode="skip") == {"1": "/d/a", "2": None}
    assert resolve([("1", "/d/a"), ("2", "/d/a")], mode="overwrite") == {"1": "/d/a", "2": "/d/a"}
    assert resolve([]) == {}


def test_plan_has_unique_destinations(spark):
    files = [file(i, name=f"IMG_{i % 7}.jpg", folder=f"/src/{i}", checksum=f"{i % 40:064x}") for i in range(100)] + [file(3, name="IMG_3.jpg", folder="/src/3")]
    df = spark.createDataFrame(files, FILE)
    planned = organise.plan(df, Settings(source="/src", destination="/d/{year}/{name}{ext}"))
    assert planned.count() == 100 == planned.select(F.lower("resolved")).distinct().count()
    assert organise.plan(df, Settings(source="/src", destination="/d/{name}{ext}", duplicate_handling="skip")).count() <= 41
    assert organise.plan_totals(planned).first().operations == 100 and organise.plan_folders(planned).count() == 1
    with pytest.raises(Exception, match="unsafe"):
        organise.plan(df, Settings(source="/src", destination="/d/../{name}")).collect()


def test_related_files_follow_their_owner(spark):
    files = [file(1, "photo.jpg"), file(2, "photo.jpg.xmp"), file(3, "photo_edit.jpg"), file(4, "other.jpg")]
    df = spark.createDataFrame(files, FILE)
    planned = organise.plan(df, Settings(source="/src", destination="/d/{year}/x{ext}"))
    got = {r.file_id: (r.resolved, r.owner_id) for r in organise.with_related(planned, df, "strict").collect()}
    main = got[1][0]
    assert got[1][1] is None and got[4][1] is None and got[2] == (main + ".xmp", 1) and got[3] == (main.replace(".jpg", "_edit.jpg"), 1)


def test_validation_order_and_globs(spark):
    df = spark.createDataFrame([(1, "/src/a.aae", datetime(2025, 1, 1)), (2, "/src/x/a.AAE", datetime(2019, 1, 1)), (3, "/other/a.aae", None), (4, "/src/b/c/d.jpg", datetime(2022, 1, 1))], "id int, path string, ts timestamp")
    rules = [*filters.date_rules(F.col("ts"), datetime(2020, 1, 1), datetime(2024, 1, 1)), filters.exclude_rule(F.col("path"), "/SRC", ["*.aae", "b/**/d.*"])]
    got = {r.id: r.rejection.rule if r.rejection else None for r in filters.validated(df, rules).collect()}
    assert got == {1: "MaxDate", 2: "MinDate", 3: "ExcludePattern", 4: "ExcludePattern"}
    every = {r.id: [f.rule for f in r.f] for r in df.withColumn("f", filters.all_failures(rules)).collect()}
    assert every[1] == ["MaxDate", "ExcludePattern"] and every[2] == ["MinDate"]
    assert filters.scan_totals(filters.validated(df.withColumn("length", F.lit(1)), rules)).first().skipped == 4
    assert filters.validated(df, []).where("is_valid").count() == 4


def test_spread_rank_under_skew(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("o"))
    got = {(r.k, r.o): r.r for r in ranking.spread_rank(df, ["k"], ["o"], "r", 7).collect()}
    seen = {}
    for k, o in sorted(got, key=lambda x: (x[0], x[1])):
        seen[k] = seen.get(k, 0) + 1
        assert got[(k, o)] == seen[k]


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"source": "/a", "exclude": ["*.x"], "time_offset": "+1:00"}')
    s, sources = load_settings(str(path), {"source": "/b", "casing": None}, {"FRAMELAKE_CASING": "upper", "FRAMELAKE_DRY_RUN": "no", "OTHER": "1"})
    assert (s.source, s.exclude, s.casing, s.dry_run) == ("/b", ("*.x",), "upper", False)
    assert {x.name: x.source for x in sources if x.source != "default"} == {"source": "override", "exclude": str(path), "time_offset": str(path), "casing": "environment", "dry_run": "environment"}
    assert settings_hash(s) != settings_hash(Settings()) and settings_hash(Settings()) == settings_hash(Settings())
    with pytest.raises(ValueError):
        load_settings(overrides={"nonsense": 1})
    assert suggestion("citty") == "city" and suggestion("zzzzzz") is None and edit_distance("kitten", "sitting") == 3
    bad = diagnose(Settings(source="", destination="/d/{yeer}", granularity="town"))
    assert len(bad.errors) == 3 and bad.hints == ["did you mean {year}?"] and bad.warnings
    assert not diagnose(Settings(source="/a", destination="/d/{year}/{name}")).errors
