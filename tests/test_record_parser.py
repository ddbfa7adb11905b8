from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.operators.record_parser import classify, faults, parse_files, records, split_lines
from framelake.sources.delimited import Grammar, parse_line, parse_lines

CODES = "feature_class string, feature_code string, description string"
STATES = "country string, admin1 string, name string"


def line(**kw):
    base = dict(id="7", name="A", ascii="A", alt="", lat="1.5", lon="-2", cls="P", code="PPL", country="XA", cc2="", admin1="01", a2="", a3="", a4="", pop="5", elev="", dem="9", tz="UTC", mod="2020-01-02")
    return "\t".join((base | kw).values())


def run(spark, lines):
    raw = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(lines)], "line_id bigint, raw_line string, fields string")
    return classify(split_lines(raw), spark.createDataFrame([("P", "PPL", "d"), ("P", "PPL", "again"), (None, "X", "")], CODES), spark.createDataFrame([("XA", "01", "n"), ("XA", "01", "m"), (None, None, None)], STATES))


def test_reasons_in_order(spark):
    cases = {
        line(): None, line(name='"A\tB"'): None, line(name='"say ""x"""'): None, line(name='A "b"'): None, line(pop=""): None, line(admin1=""): None, line(mod="2020-01-02\r"): None,
        line(name='"A'): "quoting", line(name='"A"b'): "quoting", line(name='"A""'): "quoting", line(mod='"2020-01-02"\r'): "quoting", line(mod='"2020-01-02"'): None,
        line() + "\t": "columns", "": "columns", "x": "columns", line(name='"A\tB', lat="x"): "quoting", line(lat=""): "latitude", line(lat="90.0001"): "latitude", line(lat="90"): None, line(lat="+1"): "latitude",
        line(lat="1."): "latitude", line(lat="١"): "latitude", line(lat="1\n"): "latitude", line() + "\nmore": None, line() + "\n" + line(): "columns", line(lon="180.5"): "longitude", line(lon="1e1"): "longitude", line(lat="x", lon="x"): "latitude", line(lat='"1.5"'): None,
        line(code="QQQ"): "feature_code", line(cls="H"): "feature_code", line(cls="p"): "feature_code", line(admin1="02"): "state", line(country="XB"): "state", line(country="XB", admin1=""): None,
        line(pop="-1"): "population", line(pop="12345678901"): "population", line(pop="1 "): "population", line(pop="1,000"): "population", line(admin1="zz", pop="x"): "state",
    }
    got = {r.line_id: r.reason for r in run(spark, list(cases)).select("line_id", "reason").collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert got[i] == want, (text, got[i], want)


def test_null_lines_types_and_locations(spark):
    out = run(spark, [None, line(), line(name='"A'), "x" * 1_000_000])
    rows = {r.line_id: r for r in out.collect()}
    assert rows[0].reason == "columns" and rows[0].n_fields == 0
    assert rows[1].latitude == 1.5 and rows[1].population == 5 and str(rows[1].modification_date) == "2020-01-02" and rows[1].elevation is None
    assert rows[2].syntax_error == "unterminated quote" and (rows[2].error_line, rows[2].error_column) == (1, 3)
    assert rows[3].reason == "columns"
    assert {r.line_id for r in faults(out).collect()} == {0, 2, 3} and records(out).count() == 1
    assert run(spark, []).count() == 0


def test_recovers_at_record_starts(spark):
    text = "\n".join([line(id="1"), line(id="2", name='"open'), "rest of the broken one", "9\tshort", line(id="3"), line(id="4", name='"two\nlines"'), line(id="5", name='"x"y'), line(id="6")])
    got = list(Grammar(text, 19).records())
    # The broken quote of record 2 costs the lines up to the next validated start.
    assert [(r.line, r.lines, r.error, r.error_line, r.error_column) for r in got if r.error] == [(2, 3, "unterminated quote", 2, 3), (8, 1, "text after quote", 8, 6)]
    assert [r.fields[0] for r in got if not r.error] == ["1", "3", "4", "6"] and sum(r.lines for r in got) == 9
    alone = list(Grammar(line(id="1", name='"open') + "\n" + line(id="2"), 19).records())
    assert [(r.error, r.error_line, r.error_column) for r in alone] == [("unterminated quote", 1, 3), (None, None, None)]


def test_files_are_parsed_in_blocks(spark):
    import random

    rng = random.Random(1)
    files = {"a": [], "b": [], "c": ["no record at all", '"'], "d": []}
    for i in range(400):
        kind = rng.random()
        name = '"open' if kind < 0.1 else '"two\nlines"' if kind < 0.2 else '"x"y' if kind < 0.3 else "A"
        files["a"] += line(id=str(i), name=name).split("\n") + ["junk", 'more "junk'] * (kind > 0.9)
    files["b"] = [*["lead"] * 20, line(id="1"), *['tail "\t"'] * 30, line(id="2")]
    rows = [(f, i + 1, t, 0) for f, ts in files.items() for i, t in enumerate(ts)] + [("b", 21, line(id="1"), 0), (None, 1, "x", 0), ("c", None, "x", 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file_name string, line_no bigint, raw_line string, part int")
    for block in (7, 10_000):
        got = {}
        for r in parse_files(df, block).collect():
            got.setdefault(r.file_name, []).append((r.first_line, r.n_lines, r.syntax_error, r.error_line, r.error_column, r.fields))
        for f, ts in files.items():
            want = [(r.line, r.lines, r.error, r.error_line, r.error_column, None if r.error else r.fields) for r in Grammar("\n".join(ts), 19).records()] if ts else []
            assert sorted(got.get(f, []), key=lambda r: r[0]) == want and sum(r[1] for r in want) == len(ts)


def test_many_broken_quotes_take_linear_time():
    import time

    def seconds(n):
        text = "\n".join([line(id=str(i), name='"open') for i in range(n)] + ["x"])
        began = time.perf_counter()
        assert sum(r.error is not None for r in Grammar(text, 19).records()) == n
        return time.perf_counter() - began

    assert seconds(40_000) < 20 * max(seconds(4_000), 0.01)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab"\t\n\r é', max_size=6), min_size=1, max_size=5))
def test_round_trip(fields):
    quoted = "\t".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert parse_line(quoted, len(fields)).fields == fields
    assert [r.fields for r in parse_lines([quoted, '"broken', quoted], len(fields))] == [fields, [], fields]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='1a"\t\n', max_size=40))
def test_grammar_always_ends(text):
    spans = [(r.start, r.error) for r in Grammar(text, 3).records()]
    assert [s for s, _ in spans] == sorted({s for s, _ in spans})
