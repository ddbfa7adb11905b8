"""Instants written in many forms, with and without a zone, into one UTC form.

Distinct (text, zone, date order) combinations make a dictionary; each is parsed once, in Arrow batches,
and appended to the dictionary's table. A later run parses only combinations the table lacks. Rows then get
their instant by a join on the combination; combinations that many rows share are broadcast, and their
number is bounded by their share.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.lookup import lookup_join
from framelake.session import ship_package
from framelake.storage import new_path, path_exists, write_table

#: A combination is hot, and broadcast in the join back, if it has more than one in so many rows.
HOT_ONE_IN = 1000

# Names of the months and the days of the week in English.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_MONTH = {m[:n]: i + 1 for i, m in enumerate(MONTHS) for n in (3, len(m))} | {"sept": 9}
_EPOCH = datetime(1970, 1, 1)

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_AMPM = r"(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?P<off>[Zz]|(?:UTC|GMT)(?=$|[+\-\s\[])|[+\-]\d{1,2}(?::?\d{2}(?::?\d{2})?)?|(?:UTC|GMT)[+\-]\d{1,2}(?::?\d{2})?))?(?:\s*\[(?P<br>[A-Za-z0-9_+\-/]+)\]|\s+(?P<zone>[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+))?"
_TIME = rf"{_CLOCK}{_AMPM}{_ZONE}"
_WEEKDAY = r"(?:(?P<wd>[A-Za-z]{3,9})\.?,?\s+)?"

_FORMS = [
    re.compile(p, re.ASCII)
    for p in (
        rf"(?P<y>\d{{4}})(?P<sep>[-:/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:(?:[Tt]|\s+){_TIME})?",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt_ \-](?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE}",
        rf"(?P<a>\d{{1,2}})(?P<sep>[/.\-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}})(?:,?\s+{_TIME})?",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})[\s\-](?P<mon>[A-Za-z]{{3,9}})\.?,?[\s\-](?P<y>\d{{4}})(?:,?\s+{_TIME})?",
        rf"{_WEEKDAY}(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})(?:,?\s+{_TIME})?",
        rf"(?P<wd>[A-Za-z]{{3}})\s+(?P<mon>[A-Za-z]{{3}})\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(?P<y>\d{{4}})",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
    )
]
_NUMBER = re.compile(r"(?:/Date\()?(\d{10}|\d{13}|\d{16})(?:\)/)?", re.ASCII)
_OFFSET = re.compile(r"(?:UTC|GMT)?([+\-])(\d{1,2}):?(\d{2})?:?(\d{2})?", re.ASCII)

UNREADABLE, UNZONED, NONEXISTENT, AMBIGUOUS = "unreadable", "unzoned", "nonexistent", "ambiguous"


@lru_cache(maxsize=1024)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _utc_text(micros: int) -> str | None:
    try:
        return (_EPOCH + timedelta(microseconds=micros)).strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0")
    except OverflowError:
        return None


def _micros(local: datetime) -> int:
    return (local - _EPOCH) // timedelta(microseconds=1)


def _in_zone(local: datetime, zone: ZoneInfo) -> tuple[str, int]:
    """('' and the offset in seconds), or the reason why the local time is no single instant."""
    offsets = []
    for fold in (0, 1):
        aware = local.replace(tzinfo=zone, fold=fold)
        try:
            if aware.astimezone(timezone.utc).astimezone(zone).replace(tzinfo=None) == local:
                offsets.append(aware.utcoffset())
        except OverflowError:
            return UNREADABLE, 0
    if not offsets:
        return NONEXISTENT, 0
    if len(set(offsets)) > 1:
        return AMBIGUOUS, 0
    return "", int(offsets[0].total_seconds())


def normalise(text: str, zone_id: str | None, day_first: bool | None) -> str:
    """The UTC text of a written instant, or the reason there is none.

    A null ``day_first`` is taken as false: the month comes first. An unknown name in ``zone_id`` counts as
    no zone; an unknown name in the text makes it unreadable. With both an offset and a zone name in the
    text the offset decides. A date without a time is midnight.
    """
    s = text.strip()
    number = _NUMBER.fullmatch(s)
    if number and s.startswith("/Date(") == s.endswith(")/"):
        digits = number[1]
        return _utc_text(int(digits) * {10: 1_000_000, 13: 1000, 16: 1}[len(digits)]) or UNREADABLE
    for form in _FORMS:
        m = form.fullmatch(s)
        if m:
            got = _read(m.groupdict(), zone_id, day_first)
            if got != UNREADABLE:
                return got
    return UNREADABLE


def _read(g: dict, zone_id: str | None, day_first: bool | None) -> str:
    if g.get("a"):
        day, month = (int(g["a"]), int(g["b"])) if day_first else (int(g["b"]), int(g["a"]))
    else:
        day = int(g["d"])
        month = int(g["m"]) if g.get("m") else _MONTH.get(g["mon"].lower())
    year = int(g["y"])
    if month is None or year <= 1 or (g.get("wd") and not any(d[:3] == g["wd"].lower() or d == g["wd"].lower() for d in DAYS)):
        return UNREADABLE
    hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return UNREADABLE
        hour = hour % 12 + (12 if g["ap"].lower() == "p" else 0)
    micro = int((g.get("f") or "")[:6].ljust(6, "0"))
    try:
        local = datetime(year, month, day, hour, minute, second, micro)
    except ValueError:
        return UNREADABLE
    name = g.get("br") or g.get("zone")
    named = zone_of(name) if name else None
    if name and named is None:
        return UNREADABLE
    offset = g.get("off")
    if offset:
        seconds = 0
        parts = _OFFSET.fullmatch(offset)
        if parts:
            hours, minutes, secs = (int(x or 0) for x in parts.group(2, 3, 4))
            if hours > 18 or minutes > 59 or secs > 59:
                return UNREADABLE
            seconds = (hours * 3600 + minutes * 60 + secs) * (-1 if parts[1] == "-" else 1)
        return _utc_text(_micros(local) - seconds * 1_000_000) or UNREADABLE
    zone = named or (zone_of(zone_id) if zone_id else None)
    if zone is None:
        return UNZONED
    reason, seconds = _in_zone(local, zone)
    return reason or _utc_text(_micros(local) - seconds * 1_000_000) or UNREADABLE


_KEY = ["text", "zone_id", "day_first"]
_DICTIONARY = "text string, zone_id string, day_first boolean, utc_text string, increment bigint"


def _parse_distinct(distinct: DataFrame) -> DataFrame:
    out = pa.schema([("text", pa.string()), ("zone_id", pa.string()), ("day_first", pa.bool_()), ("utc_text", pa.string())])

    def parse(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([normalise(*row) for row in zip(*cols, strict=True)], pa.string())], schema=out)

    ship_package(distinct.sparkSession)
    return distinct.select(*_KEY).mapInArrow(parse, "text string, zone_id string, day_first boolean, utc_text string")


def extend_dictionary(spark: SparkSession, path: str, rows: DataFrame, increment: int) -> DataFrame:
    """Parse the combinations of ``rows`` that the dictionary at ``path`` lacks, and append them.

    Each increment is a folder of its own that Spark commits as a whole, so a lost job leaves nothing and a
    repeated one overwrites only itself. Returns the whole dictionary.
    """
    distinct = rows.select(*_KEY).distinct()
    folder = f"{path}/increment={increment}"
    if path_exists(spark, path):
        known = spark.read.schema(_DICTIONARY).parquet(path).where(F.col("increment") != increment).select(*_KEY)
        same = [distinct[c].eqNullSafe(known[c]) for c in _KEY]
        distinct = distinct.join(known, same, "left_anti")
    _parse_distinct(distinct).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(_DICTIONARY).parquet(path)


def with_instants(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Left join of ``utc_text`` by combination.

    ``zone_id`` and ``day_first`` may be null in the key. Combinations with more than one in HOT_ONE_IN
    rows, at most HOT_ONE_IN of them, are broadcast; their rows take no part in the shuffle's skew, as they
    carry a salt that no dictionary row has.
    """
    # ' ' is no zone and keeps null keys joinable; day_first becomes an int
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_z": F.coalesce("zone_id", F.lit(" ")), "_d": F.coalesce(F.col("day_first").cast("int"), F.lit(-1))})

    rows = keyed(rows)
    entries = keyed(dictionary).select("text", "_z", "_d", F.col("utc_text"))
    counts = rows.groupBy("text", "_z", "_d").agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = counts.where(F.col("_n") * HOT_ONE_IN > total).select("text", "_z", "_d")
    hot = entries.join(F.broadcast(hot), ["text", "_z", "_d"], "left_semi").withColumnRenamed("utc_text", "_hot")
    step = rows.join(F.broadcast(hot), ["text", "_z", "_d"], "left")
    salted = step.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))))
    cold = entries.withColumn("_salt", F.lit(0).cast("bigint")).withColumnRenamed("utc_text", "_cold")
    out = salted.join(cold, ["text", "_z", "_d", "_salt"], "left")
    return out.withColumn("utc_text", F.coalesce("_hot", "_cold")).drop("_z", "_d", "_salt", "_hot", "_cold")


def written_instants(records: DataFrame, scan_runs: DataFrame, kind: str, id_column: str, text_column: str) -> DataFrame:
    """``record_kind, record_id, text, zone_id, day_first``: one row for each id whose text isn't blank.

    Of a repeated id the greatest (text, scan_id) stands. Rows without id are left out. A scan_id that is
    null or not in scan_runs has no zone; of scan_runs rows with the same id the greatest counts.
    """
    one = (
        records.select(F.col(f"`{id_column}`").alias("record_id"), "scan_id", F.col(f"`{text_column}`").alias("text"))
        .where(F.col("record_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
        .groupBy("record_id")
        .agg(F.max(F.struct("text", "scan_id")).alias("m"))
        .select("record_id", "m.text", "m.scan_id")
    )
    zones = scan_runs.where("scan_id is not null").groupBy("scan_id").agg(F.max(F.struct("zone_id", "day_first")).alias("m")).select("scan_id", "m.zone_id", "m.day_first")
    return lookup_join(one, zones, ["scan_id"]).select(F.lit(kind).alias("record_kind"), "record_id", "text", "zone_id", "day_first")


def normalised_records(spark: SparkSession, scan_results: DataFrame, copy_snapshots: DataFrame, scan_runs: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """``record_kind, record_id, utc_text`` of scan results (date_time) and snapshots (earliest_date).

    The dictionary at ``dictionary_path`` (a fresh one in the shared folder where none is given) grows by
    two increments: the scan results' combinations, then those that only the snapshots have. Empty tables
    give no rows.
    """
    path = dictionary_path or new_path(spark, "instants")
    first = 0 if not path_exists(spark, path) else 1 + (spark.read.schema(_DICTIONARY).parquet(path).agg(F.max("increment")).first()[0] or 0)
    parts = [
        written_instants(scan_results, scan_runs, "scan_result", "result_id", "date_time"),
        written_instants(copy_snapshots, scan_runs, "snapshot", "snapshot_id", "earliest_date"),
    ]
    # The rows are read for the dictionary, for the counts of hot texts and for the join: kept once.
    rows = write_table(parts[0].unionByName(parts[1]), "written-instants")
    for i, kind in enumerate(("scan_result", "snapshot")):
        dictionary = extend_dictionary(spark, path, rows.where(F.col("record_kind") == kind), first + i)
    return with_instants(rows, dictionary).select("record_kind", "record_id", "utc_text")
