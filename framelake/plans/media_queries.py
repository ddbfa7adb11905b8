"""Queries of the media operators over whole tables, each with its SQL twin."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.config import VARIABLES, Settings
from framelake.functions import coordinates, geo, text, times
from framelake.operators import collisions, enrich, filters, geocode, joins, regions, reports, state, template
from framelake.plans import organise
from framelake.session import table
from framelake.sources import sidecars

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Each file once, by its latest delivery.
LIB = "lib AS (SELECT * FROM files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seen_at DESC NULLS LAST) = 1)"
USABLE = "lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)"
TS = "coalesce(taken, created, modified)"

ROOT = "/vault"
SETTINGS = Settings(source=ROOT, destination="/library/{year}/{month}/{country}/{city|Somewhere}/{name}{ext}", min_date=datetime(2013, 1, 1), max_date=datetime(2024, 12, 31), exclude=("**/*.mov", "*/2015/**"))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _lib(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return enrich.library(table(spark, d, "files"), *columns)


DATES = ("taken", "created", "modified")
POSITION = ("lat", "lon")


# --- scan, validation ---------------------------------------------------------------------------------

_CHECKS = f"""
checked AS (
  SELECT file_id, length,
    {TS} > TIMESTAMPTZ '2024-12-31 00:00:00+00' AS late, {TS} < TIMESTAMPTZ '2013-01-01 00:00:00+00' AS early,
    CASE WHEN regexp_matches(lower(rel), '^(?:[^/]+/)*[^/]*\\.mov$') THEN '**/*.mov' WHEN regexp_matches(lower(rel), '^[^/]*/2015/.*$') THEN '*/2015/**' END AS pat
  FROM (SELECT *, CASE WHEN starts_with(lower(path), '/vault/') THEN substr(path, 8) ELSE regexp_extract(path, '([^/]*)$', 1) END AS rel FROM lib))"""


def _rules(rows: DataFrame) -> list[filters.Rule]:
    return [*filters.date_rules(F.col("ts"), SETTINGS.min_date, SETTINGS.max_date), filters.exclude_rule(F.col("path"), ROOT, SETTINGS.exclude)]


def _validated(spark: SparkSession, d: str) -> DataFrame:
    rows = _lib(spark, d, *DATES, "path", "length").withColumn("ts", F.coalesce("taken", "created", "modified"))
    return filters.validated(rows, _rules(rows))


@query(f"""WITH {LIB}, {_CHECKS}
SELECT file_id, NOT coalesce(late, false) AND NOT coalesce(early, false) AND pat IS NULL AS is_valid,
  CASE WHEN late THEN 'MaxDate' WHEN early THEN 'MinDate' WHEN pat IS NOT NULL THEN 'ExcludePattern' END AS rule,
  CASE WHEN late THEN 'after 2024-12-31 00:00:00' WHEN early THEN 'before 2013-01-01 00:00:00' WHEN pat IS NOT NULL THEN 'matches ' || pat END AS reason
FROM checked""")
def scan_valid(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("file_id", "is_valid", F.col("rejection.rule").alias("rule"), F.col("rejection.reason").alias("reason"))


@query(f"""WITH {LIB}, {_CHECKS}, v AS (SELECT length, NOT coalesce(late, false) AND NOT coalesce(early, false) AND pat IS NULL AS ok FROM checked)
SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS skipped, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_bytes FROM v""")
def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    return filters.scan_totals(_validated(spark, d))


@query(f"""WITH {LIB}, {_CHECKS}
SELECT file_id, 'MaxDate' AS rule FROM checked WHERE late UNION ALL SELECT file_id, 'MinDate' FROM checked WHERE early
UNION ALL SELECT file_id, 'ExcludePattern' FROM checked WHERE pat IS NOT NULL""")
def validate_all_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = _lib(spark, d, *DATES, "path").withColumn("ts", F.coalesce("taken", "created", "modified"))
    return rows.select("file_id", F.explode(filters.all_failures(_rules(rows))).alias("f")).select("file_id", "f.rule")


@query(f"""WITH {LIB} SELECT file_id, path FROM lib WHERE len(string_split(CASE WHEN starts_with(lower(path), '/vault/') THEN substr(path, 8) ELSE regexp_extract(path, '([^/]*)$', 1) END, '/')) <= 3""")
def scan_depth(spark: SparkSession, d: str) -> DataFrame:
    return _lib(spark, d, "path").where(filters.within_depth(F.col("path"), ROOT, 3)).select("file_id", "path")


@query(f"""WITH {LIB} SELECT file_id, coalesce(lower(ext) IN ('.jpg', '.jpeg', '.png', '.heic', '.mov', '.mp4', '.avi', '.cr2', '.raf', '.nef', '.arw', '.dng'), false) AS supported FROM lib""")
def supported_files(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enriched(_lib(spark, d, *enrich.ENRICHED_FROM), Settings()).select("file_id", "supported")


# --- enrichment ---------------------------------------------------------------------------------------


@query(f"""WITH {LIB} SELECT file_id, epoch_us({TS}) AS ts_us, CASE WHEN taken IS NOT NULL THEN 'taken' WHEN created IS NOT NULL THEN 'created' WHEN modified IS NOT NULL THEN 'modified' END AS source FROM lib""")
def choose_timestamp(spark: SparkSession, d: str) -> DataFrame:
    picked = times.chosen_timestamp(F.col("taken"), F.col("created"), F.col("modified"))
    return _lib(spark, d, *DATES).select("file_id", F.unix_micros(picked["ts"]).alias("ts_us"), picked["source"].alias("source"))


@query(f"WITH {LIB} SELECT file_id, epoch_us({TS}) + 95400000000 AS ts_us FROM lib")
def time_offset(spark: SparkSession, d: str) -> DataFrame:
    ts = times.shifted(F.coalesce("taken", "created", "modified"), times.parse_offset("+1d2:30"))
    return _lib(spark, d, *DATES).select("file_id", F.unix_micros(ts).alias("ts_us"))


@query(f"""WITH {LIB} SELECT file_id, CASE WHEN {USABLE} THEN round_even(lon / 15 * 2, 0) / 2 + 0.0 END AS hours,
  epoch_us({TS}) + CASE WHEN {USABLE} THEN CAST(round_even(lon / 15 * 2, 0) / 2 * 3600 * 1000000 AS BIGINT) ELSE 0 END AS ts_us FROM lib""")
def timezone_gps(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.enriched(_lib(spark, d, *enrich.ENRICHED_FROM), Settings(zone_mode="gps"))
    return rows.select("file_id", (times.longitude_offset_hours(F.col("lon")) + 0.0).alias("hours"), F.unix_micros("ts").alias("ts_us"))


@query("""WITH m AS (SELECT *, trim(coalesce(make, '')) AS a, trim(coalesce(model, '')) AS b FROM lib),
  c AS (SELECT *, CASE WHEN b = '' THEN a WHEN a = '' THEN b WHEN starts_with(lower(b), lower(a)) THEN b ELSE a || ' ' || b END AS cam,
    coalesce(CASE WHEN trim(album_xmp) <> '' THEN album_xmp END, CASE WHEN trim(album_iptc) <> '' THEN album_iptc END, CASE WHEN trim(album_xp) <> '' THEN album_xp END,
      CASE WHEN starts_with(lower(description), 'album:') AND trim(substr(description, 7)) <> '' THEN trim(substr(description, 7)) END) AS alb FROM m)
SELECT file_id, nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(cam, '[\\x00-\\x1F<>:"/\\\\|?*]', '_', 'g')), '\\.+$', ''), '\\s+', ' ', 'g')), '') AS camera,
  nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(alb, '[\\x00-\\x1F<>:"/\\\\|?*]', '_', 'g')), '\\.+$', ''), '\\s+', ' ', 'g')), '') AS album FROM c""".replace("WITH m", f"WITH {LIB}, m", 1))
def camera_album(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enriched(_lib(spark, d, *enrich.ENRICHED_FROM), Settings()).select("file_id", "camera", "album")


@query("""SELECT event_id, CAST(json_extract_string(j, '$.photoTakenTime.timestamp') AS BIGINT) * 1000000 AS taken_us,
  CASE WHEN abs(la) < 1e-4 AND abs(lo) < 1e-4 THEN NULL ELSE la END AS lat, CASE WHEN abs(la) < 1e-4 AND abs(lo) < 1e-4 THEN NULL ELSE lo END AS lon, event_type AS title
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2 AS la, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS lo,
  '{"photoTakenTime":{"timestamp":"' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1500000000 AS VARCHAR) || '"}}' AS j FROM events)""")
def photo_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    made = F.concat(
        F.lit('{"photoTakenTime":{"timestamp":"'), (k.cast("bigint") + 1500000000).cast("string"), F.lit('"},"geoData":{"latitude":'), (k.cast("double") / 2).cast("string"),
        F.lit(',"longitude":'), k.cast("double").cast("string"), F.lit('},"title":"'), F.col("event_type"), F.lit('"}'),
    )
    rows = table(spark, d, "events").withColumn("s", sidecars.photo_json(made))
    return rows.select("event_id", F.unix_micros("s.taken").alias("taken_us"), "s.lat", "s.lon", "s.title")


# --- scalars ------------------------------------------------------------------------------------------

_WORDS = "list_filter(string_split(regexp_replace(translate(name, '_-.', '   '), '([A-Z][a-z])', ' \\1', 'g'), ' '), lambda w: w <> '')"
_CAP = "upper(substr(w, 1, 1)) || lower(substr(w, 2))"


@query(f"""SELECT place_id, lower(name) AS c_lower, upper(name) AS c_upper, coalesce(array_to_string(list_transform(w, lambda w: {_CAP}), ' '), '') AS c_title,
  array_to_string(list_transform(w, lambda w: {_CAP}), '') AS c_pascal,
  array_to_string(list_transform(w, lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE {_CAP} END), '') AS c_camel,
  lower(array_to_string(w, '_')) AS c_snake, lower(array_to_string(w, '-')) AS c_kebab, upper(array_to_string(w, '_')) AS c_screaming_snake
FROM (SELECT place_id, name, {_WORDS} AS w FROM places WHERE name IS NOT NULL)""")
def casing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "places").where("name is not null")
    return rows.select("place_id", *[text.apply_casing(F.col("name"), c).alias(f"c_{c}") for c in text.CASINGS if c != "original"])


_SANITIZED = """CASE WHEN trim(coalesce(description, '')) = '' THEN '' WHEN upper(split_part(s, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') THEN s || '_' ELSE s END"""


@query(f"""WITH {LIB}, c AS (SELECT file_id, description, regexp_replace(trim(regexp_replace(description, '[\\x00-\\x1F<>:"/\\\\|?*]', '_', 'g')), '\\.+$', '') AS s FROM lib)
SELECT file_id, {_SANITIZED} AS segment, coalesce(regexp_matches(description, '[\\x00-\\x1F<>:"/\\\\|?*]'), false) AS invalid FROM c""")
def sanitize_segment(spark: SparkSession, d: str) -> DataFrame:
    return _lib(spark, d, "description").select("file_id", text.sanitize_segment(F.col("description")).alias("segment"), text.has_invalid_chars(F.col("description")).alias("invalid"))


def _bytes_sql(column: str) -> str:
    units = "".join(f" WHEN abs({column}) >= {1024**i} THEN round(abs({column}) / {1024**i}.0::DOUBLE, 2)" for i in (4, 3, 2, 1))
    names = "".join(f" WHEN abs({column}) >= {1024**i} THEN ' {u}'" for i, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))
    value = f"CASE{units} ELSE abs({column})::DOUBLE END"
    return f"CASE WHEN {column} = 0 THEN '0 B' ELSE CASE WHEN {column} < 0 THEN '-' ELSE '' END || regexp_replace(regexp_replace(CAST(CAST({value} AS DECIMAL(30, 2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || CASE{names} ELSE ' B' END END"


@query(f"WITH {LIB} SELECT file_id, {_bytes_sql('length')} AS size_text FROM lib WHERE length IS NOT NULL")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _lib(spark, d, "length").where("length is not null").select("file_id", text.format_bytes(F.col("length")).alias("size_text"))


@query(f"""WITH {LIB} SELECT file_id, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '(\\.[^.]*)$', 1) AS ext, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(path, '/[^/]*$', '') AS folder,
  CASE WHEN length(name) > 12 THEN '...' || right(name, 9) ELSE name END AS short FROM lib""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    n, p = F.col("name"), F.col("path")
    return _lib(spark, d, "name", "path").select("file_id", text.file_stem(n).alias("stem"), text.file_extension(n).alias("ext"), text.base_name(p).alias("base"), text.dir_name(p).alias("folder"), text.truncate_name(n, 12).alias("short"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS duration
FROM (SELECT event_id, CAST(floor(abs(value) * 37) AS BIGINT) AS s FROM events)""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.format_duration(F.floor(F.abs("value") * 37)).alias("duration"))


@query("""SELECT place_id, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) THEN lat END AS lat,
  CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) THEN lon END AS lon
FROM (SELECT place_id, CAST(CAST(lat AS DECIMAL(20, 5)) AS DOUBLE) AS lat, CAST(CAST(lon AS DECIMAL(20, 5)) AS DOUBLE) AS lon FROM places)""")
def iso6709(spark: SparkSession, d: str) -> DataFrame:
    sign = lambda c: F.concat(F.when(F.col(c) < 0, "-").otherwise("+"), F.abs(F.col(c).cast("decimal(20,5)")).cast("string"))
    got = coordinates.iso6709(F.concat(sign("lat"), sign("lon"), F.lit("+010.0/")))
    return table(spark, d, "places").select("place_id", got["lat"].alias("lat"), got["lon"].alias("lon"))


@query("""SELECT place_id, CASE WHEN lat BETWEEN -90 AND 90 THEN round(sign(lat) * (floor(abs(lat)) + 30.25 / 60), 9) END AS lat FROM places WHERE lat IS NOT NULL AND lat <> 0 AND abs(lat) < 90""")
def xmp_coordinate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "places").where("lat is not null and lat <> 0 and abs(lat) < 90")
    made = F.concat(F.floor(F.abs("lat")).cast("string"), F.lit(",30.25"), F.when(F.col("lat") < 0, "S").otherwise("N"))
    return rows.select("place_id", F.round(coordinates.xmp_coordinate(made, False), 9).alias("lat"))


@query("SELECT place_id, CASE WHEN lon BETWEEN -180 AND 180 THEN lon ELSE lon + 180 - 360 * floor((lon + 180) / 360) - 180 END AS lon, least(greatest(lat, -90), 90) AS lat, CAST(trunc(lat * 100) AS BIGINT) / 100 AS q FROM places WHERE lat IS NOT NULL AND lon IS NOT NULL")
def normalised_coordinates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "places").where("lat is not null and lon is not null")
    return rows.select("place_id", geo.normalise_longitude(F.col("lon")).alias("lon"), geo.clamp_latitude(F.col("lat")).alias("lat"), geo.quantise(F.col("lat"), 100).alias("q"))


@query("""SELECT feature_code, feature_class, (SELECT min(v) FROM (VALUES """ + ", ".join(f"('{v}')" for v in VARIABLES) + """) t(v) WHERE levenshtein(lower(feature_code), v) <= 2) AS suggestion FROM feature_codes""")
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feature_codes").select("feature_code", "feature_class")
    near = F.array_compact(F.array(*[F.when(F.levenshtein(F.lower("feature_code"), F.lit(v), 2) >= 0, F.lit(v)) for v in VARIABLES]))
    return rows.withColumn("suggestion", F.array_min(near))


@query(f"""WITH {LIB} SELECT file_id, path LIKE '/%' AND NOT list_contains(string_split_regex(path, '[/\\\\]'), '..') AND (lower(path) = '/vault/s0000003' OR starts_with(lower(path), '/vault/s0000003/')) AS safe FROM lib""")
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    return _lib(spark, d, "path").select("file_id", filters.safe_path(F.col("path"), "/vault/s0000003").alias("safe"))


@query("SELECT doc_id, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def content_checksum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("checksum"))


# --- counts and reports -------------------------------------------------------------------------------


@query(f"""WITH {LIB}, l AS (SELECT unnest([{{'level': 'district', 'key': lower(location.district)}}, {{'level': 'city', 'key': lower(location.city)}}, {{'level': 'county', 'key': lower(location.county)}},
  {{'level': 'state', 'key': lower(location.state)}}, {{'level': 'country', 'key': lower(location.country)}}]) AS p FROM lib WHERE location IS NOT NULL)
SELECT p.level AS level, p.key AS key, count(*) AS n FROM l WHERE trim(p.key) <> '' GROUP BY ALL""")
def location_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.location_counts(_lib(spark, d, "location"))


@query(f"""WITH {LIB} SELECT count(*) AS total_files, count(*) FILTER (lower(ext) IN {reports.PHOTO_EXTENSIONS}) AS photos, count(*) FILTER (lower(ext) IN {reports.VIDEO_EXTENSIONS}) AS videos,
  count(*) FILTER (location IS NOT NULL) AS with_location, count(DISTINCT CASE WHEN trim(location.country) <> '' THEN lower(location.country) END) AS countries,
  count(DISTINCT CASE WHEN trim(coalesce(location.city, location.district)) <> '' THEN lower(coalesce(location.city, location.district)) END) AS cities,
  CAST(coalesce(sum(length), 0) AS BIGINT) AS total_bytes, min(epoch_us({TS})) AS earliest_us, max(epoch_us({TS})) AS latest_us FROM lib""")
def copy_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reports.copy_statistics(_lib(spark, d, *DATES, "ext", "location", "length").withColumn("ts", F.coalesce("taken", "created", "modified")))


@query(f"WITH {LIB} SELECT lower(ext) AS ext, count(*) AS n FROM lib WHERE ext <> '' GROUP BY 1")
def extension_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return reports.extension_breakdown(_lib(spark, d, "ext"))


def _top_sql(source: str, key: str, k: int) -> str:
    return f"""r AS (SELECT {key}, n, row_number() OVER (ORDER BY n DESC, {key}) AS rn, sum(n) OVER () AS total FROM {source})
SELECT CASE WHEN rn <= {k} THEN {key} ELSE '(other)' END AS {key}, CAST(sum(n) AS BIGINT) AS n, round(100.0 * sum(n)::DOUBLE / min(total), 1) AS percent FROM r GROUP BY 1"""


@query(f"WITH {LIB}, e AS (SELECT lower(ext) AS ext, count(*) AS n FROM lib WHERE ext <> '' GROUP BY 1), {_top_sql('e', 'ext', 3)}")
def extension_top(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_with_other(reports.extension_breakdown(_lib(spark, d, "ext")), "ext", 3)


@query(f"WITH {LIB}, e AS (SELECT lower(location.city) AS key, count(*) AS n FROM lib WHERE trim(location.city) <> '' GROUP BY 1), {_top_sql('e', 'key', 15)}")
def city_top(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_with_other(reports.location_counts(_lib(spark, d, "location")).where("level = 'city'").select("key", "n"), "key", 15)


@query(f"""WITH {LIB}, u AS (SELECT * FROM lib WHERE location IS NULL AND unknown_reason <> 'None')
SELECT 'reason' AS kind, unknown_reason AS key, count(*) AS n FROM u GROUP BY 2
UNION ALL SELECT 'extension', CASE WHEN coalesce(ext, '') = '' THEN '(no extension)' ELSE lower(ext) END, count(*) FROM u GROUP BY 2""")
def unknown_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.unknown_report(_lib(spark, d, "location", "unknown_reason", "ext"))


@query(f"""WITH {LIB} SELECT file_id, name, CASE unknown_reason WHEN 'NoGpsData' THEN 'No GPS data in file metadata' WHEN 'GpsExtractionError' THEN 'Error extracting GPS data' WHEN 'GeocodingFailed' THEN 'Geocoding failed to find location' ELSE 'Unknown' END AS reason_text,
  CASE unknown_reason WHEN 'NoGpsData' THEN 'NO-GPS' WHEN 'GpsExtractionError' THEN 'GPS-ERR' WHEN 'GeocodingFailed' THEN 'GEO-FAIL' ELSE 'UNKNOWN' END AS reason_code FROM lib WHERE location IS NULL AND unknown_reason <> 'None'""")
def unknown_files(spark: SparkSession, d: str) -> DataFrame:
    return reports.unknown_files(_lib(spark, d, "location", "unknown_reason", "name"))


# --- duplicates, pairs, related -----------------------------------------------------------------------


@query(f"""WITH {LIB}, k AS (SELECT lower(trim(checksum)) AS checksum, path FROM lib WHERE trim(checksum) <> '')
SELECT checksum, count(*) OVER w AS n, min(path) OVER w AS first_path, path FROM k WINDOW w AS (PARTITION BY checksum) QUALIFY count(*) OVER w > 1""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return joins.duplicate_groups(_lib(spark, d, "path", "checksum"))


@query(f"WITH {LIB} SELECT lower(trim(checksum)) AS checksum, min(path) AS first_path FROM lib WHERE trim(checksum) <> '' GROUP BY 1")
def unique_first(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_of_checksum(_lib(spark, d, "path", "checksum"))


@query(f"""WITH {LIB}, f AS (SELECT lower(trim(checksum)) AS c, min(path) AS first_path FROM lib WHERE trim(checksum) <> '' GROUP BY 1)
SELECT file_id, path, first_path AS original FROM lib JOIN f ON lower(trim(checksum)) = c WHERE lower(path) <> lower(first_path)""")
def duplicate_of(spark: SparkSession, d: str) -> DataFrame:
    return joins.duplicate_of(_lib(spark, d, "path", "checksum"))


@query(f"""WITH {LIB}, p AS (SELECT dir, lower(stem) AS s, arg_min(file_id, (CASE WHEN location IS NULL THEN 1 ELSE 0 END, path)) AS photo, arg_min(location, (CASE WHEN location IS NULL THEN 1 ELSE 0 END, path)) AS loc
  FROM lib WHERE lower(ext) IN ('.heic', '.heif', '.jpg', '.jpeg') AND (location IS NOT NULL OR taken IS NOT NULL OR created IS NULL) GROUP BY 1, 2)
SELECT v.file_id, p.photo AS paired_with, p.loc.city AS city FROM lib v JOIN p ON v.dir = p.dir AND lower(v.stem) = p.s WHERE lower(v.ext) = '.mov' AND v.location IS NULL AND p.loc IS NOT NULL""")
def live_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.enriched(_lib(spark, d, *enrich.ENRICHED_FROM, "path", "dir", "stem", "location", "unknown_reason"), Settings())
    return joins.live_pairs(rows).where("paired_with is not null").select("file_id", "paired_with", F.col("location.city").alias("city"))


@query(f"""WITH {LIB}, t AS (SELECT file_id, epoch_us({TS}) AS us, CASE WHEN {USABLE} THEN lat END AS la, CASE WHEN {USABLE} THEN lon END AS lo, location IS NULL AND unknown_reason = 'NoGpsData' AS ask FROM lib WHERE {TS} IS NOT NULL),
  c AS (SELECT us, arg_min(file_id, file_id) AS cid, arg_min(la, file_id) AS la, arg_min(lo, file_id) AS lo FROM t WHERE la IS NOT NULL GROUP BY us),
  q AS (SELECT file_id, us FROM t WHERE ask AND la IS NULL),
  b AS (SELECT q.file_id, q.us, c.us AS cus, c.cid, c.la, c.lo FROM q ASOF JOIN c ON q.us >= c.us),
  a AS (SELECT q.file_id, q.us, c.us AS cus, c.cid, c.la, c.lo FROM q ASOF JOIN c ON q.us <= c.us)
SELECT file_id, cid AS from_id, la AS lat, lo AS lon, abs(us - cus) AS gap_us FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
WHERE abs(us - cus) <= 7200000000 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY abs(us - cus), cus DESC) = 1""")
def companion_position(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.enriched(_lib(spark, d, *enrich.ENRICHED_FROM, "location", "unknown_reason"), Settings())
    need = F.col("location").isNull() & (F.col("unknown_reason") == "NoGpsData") & F.col("lat").isNull()
    return joins.nearest_position(rows.withColumn("needs_position", need), 120)


@query(f"""WITH {LIB} SELECT m.file_id AS main_id, r.file_id AS related_id FROM lib m JOIN lib r ON m.dir = r.dir AND lower(m.path) <> lower(r.path)
  AND (lower(r.stem) = lower(m.stem) OR (starts_with(lower(r.stem), lower(m.stem)) AND substr(lower(r.name), length(m.stem) + 1, 1) IN ('.', '_')))""")
def related_files(spark: SparkSession, d: str) -> DataFrame:
    return joins.related_files(_lib(spark, d, "path", "dir", "name", "stem"), "strict")


@query(f"""WITH {LIB}, s AS (SELECT DISTINCT regexp_replace(full_path, '/[^/]*$', '') AS dir, regexp_extract(full_path, '([^/]*)$', 1) AS name, full_path AS path FROM scan_results WHERE lower(full_path) LIKE '%.xmp')
SELECT l.file_id, arg_min(s.path, (CASE WHEN lower(s.name) = lower(l.name) || '.xmp' THEN 0 ELSE 1 END, s.path)) AS sidecar_path
FROM lib l JOIN s ON l.dir = s.dir AND lower(s.name) IN (lower(l.name) || '.xmp', lower(l.stem) || '.xmp') GROUP BY 1""")
def sidecar_lookup(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "scan_results").where(F.lower("full_path").endswith(".xmp")).select(F.col("full_path").alias("path")).distinct()
    held = held.select(text.dir_name(F.col("path")).alias("dir"), text.base_name(F.col("path")).alias("name"), "path")
    return joins.sidecar_matches(_lib(spark, d, "dir", "name", "stem"), held, (".xmp",))


# --- plans --------------------------------------------------------------------------------------------


def _clean_sql(column: str) -> str:
    return f"regexp_replace(trim(regexp_replace(coalesce({column}, ''), '[\\x00-\\x1F<>:\"/\\\\|?*]', '_', 'g')), '\\.+$', '')"


_NORMAL = "regexp_replace(regexp_replace({}, '[\\\\/]{{2,}}', '/', 'g'), '[\\\\/][-_]+[\\\\/]', '/', 'g')"
_PLANNED = f"""{LIB}, {_CHECKS}, d AS (SELECT l.file_id, path, l.length, {_NORMAL.format(
    f"'/library/' || strftime(timezone('UTC', {TS}), '%Y/%m') || '/' || coalesce(nullif({_clean_sql('location.country')}, ''), 'Unknown') || '/' || coalesce(nullif({_clean_sql('coalesce(location.city, location.district)')}, ''), 'Somewhere') || '/' || stem || ext"
)} AS destination FROM lib l JOIN checked c USING (file_id) WHERE NOT coalesce(late, false) AND NOT coalesce(early, false) AND pat IS NULL),
 p AS (SELECT *, row_number() OVER (PARTITION BY lower(destination) ORDER BY path) - 1 AS k FROM d),
 planned AS (SELECT file_id, path, length, destination, CASE WHEN k = 0 THEN destination ELSE regexp_replace(destination, '\\.[^./]*$', '') || '-' || k || regexp_extract(destination, '(\\.[^./]*)$', 1) END AS resolved FROM p)"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    return organise.plan(table(spark, d, "files"), SETTINGS)


@query(f"WITH {_PLANNED} SELECT file_id, path, length, destination, resolved FROM planned")
def organise_plan(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d)


@query(f"WITH {_PLANNED} SELECT count(resolved) AS operations, count(DISTINCT lower(regexp_replace(resolved, '/[^/]*$', ''))) AS folders, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_bytes FROM planned")
def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    return organise.plan_totals(_planned(spark, d))


@query(f"WITH {_PLANNED} SELECT min(regexp_replace(resolved, '/[^/]*$', '')) AS folder FROM planned GROUP BY lower(regexp_replace(resolved, '/[^/]*$', ''))")
def plan_folders(spark: SparkSession, d: str) -> DataFrame:
    return organise.plan_folders(_planned(spark, d))


_THRESHOLD = Settings(source=ROOT, destination="/out/{year}/{city?min=50|country?min=20|Misc}/{album|}/{name}{ext}")


@query(f"""WITH {LIB}, n AS (SELECT *, coalesce(location.city, location.district) AS ci, location.country AS co FROM lib),
  c AS (SELECT lower(ci) AS k, count(*) AS n FROM n WHERE trim(ci) <> '' GROUP BY 1), o AS (SELECT lower(co) AS k, count(*) AS n FROM n WHERE trim(co) <> '' GROUP BY 1)
SELECT file_id, {_NORMAL.format("'/out/' || strftime(timezone('UTC', " + TS + "), '%Y') || '/' || CASE WHEN " + _clean_sql('ci') + " <> '' AND c.n >= 50 THEN " + _clean_sql('ci') + " WHEN " + _clean_sql('co') + " <> '' AND o.n >= 20 THEN " + _clean_sql('co') + " ELSE 'Misc' END || '/' || coalesce(album, '') || '/' || stem || ext")} AS destination
FROM n LEFT JOIN c ON c.k = lower(ci) LEFT JOIN o ON o.k = lower(co) LEFT JOIN (SELECT file_id, album FROM ({ORACLE_SQL['camera_album'].replace(f'WITH {LIB}, ', 'WITH ')})) USING (file_id)""")
def threshold_path(spark: SparkSession, d: str) -> DataFrame:
    return organise.destinations(_lib(spark, d, *enrich.ENRICHED_FROM, "path", "dir", "name", "stem", "location"), _THRESHOLD).select("file_id", "destination")


@query(f"""WITH {LIB}, d AS (SELECT file_id, path, '/flat/' || lower(name) AS destination FROM lib), p AS (SELECT *, row_number() OVER (PARTITION BY lower(destination) ORDER BY path, file_id) - 1 AS k FROM d)
SELECT file_id, CASE WHEN k = 0 THEN destination END AS resolved FROM p""")
def collision_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = _lib(spark, d, "path", "name").select("file_id", F.concat_ws("\x00", "path", F.lpad(F.col("file_id").cast("string"), 20, "0")).alias("path"), F.concat(F.lit("/flat/"), F.lower("name")).alias("destination"))
    return collisions.resolve_collisions(rows, mode="skip").select("file_id", "resolved")


@query(f"WITH {LIB} SELECT file_id, path FROM lib WHERE NOT EXISTS (SELECT 1 FROM scan_results s WHERE lower(s.full_path) = lower(lib.path))")
def not_existing(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "scan_results").select(F.col("full_path").alias("path"))
    return joins.not_existing(_lib(spark, d, "path").select("file_id", "path"), held, "path")


# --- places and borders -------------------------------------------------------------------------------


def _geohash_sql(lat: str, lon: str, precision: int) -> str:
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    x = f"least(greatest(CAST(floor(({lon} + 180) / 360 * {1 << nx}) AS BIGINT), 0), {(1 << nx) - 1})"
    y = f"least(greatest(CAST(floor(({lat} + 90) / 180 * {1 << ny}) AS BIGINT), 0), {(1 << ny) - 1})"
    bits = []
    for i in range(nx + ny):
        source, place = (x, nx - 1 - i // 2) if i % 2 == 0 else (y, ny - 1 - i // 2)
        bits.append(f"((({source}) >> {place}) & 1) * {1 << (nx + ny - 1 - i)}")
    code = f"({' + '.join(bits)})"
    return " || ".join(f"substr('{geo.ALPHABET}', CAST((({code} >> {5 * (precision - 1 - i)}) & 31) + 1 AS INTEGER), 1)" for i in range(precision))


@query(f"WITH {LIB} SELECT file_id, {_geohash_sql('lat', 'lon', 4)} AS cell FROM lib WHERE {USABLE}")
def geohash_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = _lib(spark, d, *POSITION).where(enrich.has_coordinates(F.col("lat"), F.col("lon")))
    return rows.select("file_id", geo.geohash(F.col("lat"), F.col("lon"), 4).alias("cell"))


_HAV = "2 * 6371.0::DOUBLE * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0)))"


def _haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return _HAV.format(a=a)


@query(f"SELECT place_id, round({_haversine_sql('lat', 'lon', '48.8566::DOUBLE', '2.3522::DOUBLE')}, 3) AS km FROM places WHERE {USABLE}")
def haversine(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "places").where(enrich.has_coordinates(F.col("lat"), F.col("lon")))
    return rows.select("place_id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.8566), F.lit(2.3522)), 3).alias("km"))


_KIND = "CASE WHEN feature_code = 'PPLC' THEN 5 WHEN starts_with(feature_code, 'PPLA') THEN 4 WHEN feature_code = 'PPLX' THEN 0 WHEN feature_code = 'PPLL' THEN 1 WHEN coalesce(population, 0) >= 100000 THEN 3 WHEN coalesce(population, 0) >= 10000 THEN 2 ELSE 1 END"
_PRIORITY = "CASE WHEN feature_code = 'PPLC' THEN 100 WHEN starts_with(feature_code, 'PPLA') THEN 80 WHEN feature_code = 'PPL' THEN 60 WHEN feature_code = 'PPLX' THEN 40 WHEN feature_code = 'PPLL' THEN 20 WHEN starts_with(feature_code, 'PPL') THEN 50 ELSE 10 END"


@query(f"SELECT place_id, {_KIND} AS kind, {_PRIORITY} AS priority FROM places WHERE {USABLE} AND feature_class IN ('P', 'A') AND coalesce(population, 0) >= 500")
def place_index(spark: SparkSession, d: str) -> DataFrame:
    return geocode.place_index(table(spark, d, "places"), minimum_population=500, classes=("P", "A")).select("place_id", "kind", "priority")


def _near_sql(classes: str, limit: str) -> str:
    x, y = "least(greatest(CAST(floor(({} + 180) / 360 * 1024) AS BIGINT), 0), 1023)", "least(greatest(CAST(floor(({} + 90) / 180 * 1024) AS BIGINT), 0), 1023)"
    return f"""{LIB}, pts AS (SELECT DISTINCT lat, lon FROM lib WHERE {USABLE}),
  pl AS (SELECT place_id, name, trim(country) AS country, admin1, population, lat AS plat, lon AS plon, {_KIND} AS kind, {_PRIORITY} AS priority, {x.format('lon')} AS x, {y.format('lat')} AS y FROM places WHERE {USABLE} AND feature_class IN ({classes})),
  nb AS (SELECT pl.* EXCLUDE (x, y), (x + dx + 1024) % 1024 AS x, y + dy AS y FROM pl, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE y + dy BETWEEN 0 AND 1023),
  km AS (SELECT pts.lat, pts.lon, nb.* EXCLUDE (x, y), {_haversine_sql('pts.lat', 'pts.lon', 'nb.plat', 'nb.plon')} AS km FROM pts JOIN nb ON {x.format('pts.lon')} = nb.x AND {y.format('pts.lat')} = nb.y),
  near AS (SELECT * FROM km WHERE km {limit})"""


@query(f"""WITH {_near_sql("'P'", '< 50')},
  a AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY round(km, 6), place_id) = 1),
  c AS (SELECT * FROM near WHERE kind >= 2 QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY round(km, 6), place_id) = 1)
SELECT a.lat, a.lon, a.place_id AS any_id, round(round(a.km, 6), 3) AS any_km, c.place_id AS city_id, a.admin1 AS state, a.country AS country FROM a LEFT JOIN c ON a.lat = c.lat AND a.lon = c.lon""")
def nearest_place(spark: SparkSession, d: str) -> DataFrame:
    got = geocode.nearest_places(_lib(spark, d, *POSITION).select("lat", "lon"), geocode.place_index(table(spark, d, "places")))
    return got.select("lat", "lon", "any_id", F.round("any_km", 3).alias("any_km"), "city_id", "state", "country")


@query(f"""WITH {_near_sql("'P', 'A'", '<= 50')}, r AS (SELECT *, km > 15 AS far FROM near),
  a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY far, CASE WHEN far THEN 0 ELSE -priority END, round(km, 6), place_id) = 1),
  c AS (SELECT * FROM r WHERE population >= 100000 QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY far, CASE WHEN far THEN 0 ELSE -priority END, round(km, 6), place_id) = 1)
SELECT a.lat, a.lon, a.place_id AS any_id, c.place_id AS city_id FROM a LEFT JOIN c ON a.lat = c.lat AND a.lon = c.lon""")
def streamed_geocode(spark: SparkSession, d: str) -> DataFrame:
    return geocode.streamed_geocode(_lib(spark, d, *POSITION).select("lat", "lon"), geocode.place_index(table(spark, d, "places"), classes=("P", "A")))


def _odd_sql(ring: str) -> str:
    e = lambda i: f"{ring}[{i}]"
    nxt = f"{ring}[CASE WHEN i = len({ring}) THEN 1 ELSE i + 1 END]"
    return f"len(list_filter(range(1, len({ring}) + 1), lambda i: (({e('i')}.lat > p.lat) <> ({nxt}.lat > p.lat)) AND p.lon < ({nxt}.lon - {e('i')}.lon) * (p.lat - {e('i')}.lat) / ({nxt}.lat - {e('i')}.lat) + {e('i')}.lon)) % 2 = 1"


_EXTENT = "list_min(list_transform(ring, lambda q: q.lat)) AS y0, list_max(list_transform(ring, lambda q: q.lat)) AS y1, list_min(list_transform(ring, lambda q: q.lon)) AS x0, list_max(list_transform(ring, lambda q: q.lon)) AS x1"
_INSIDE = f"""{LIB}, p AS (SELECT DISTINCT lat, lon FROM lib WHERE {USABLE}),
  box AS (SELECT *, {_EXTENT} FROM boundaries),
  grid AS (SELECT polygon_id, gx, unnest(range(CAST(floor(y0) AS INTEGER), CAST(floor(y1) AS INTEGER) + 1)) AS gy FROM (SELECT polygon_id, y0, y1, unnest(range(CAST(floor(x0) AS INTEGER), CAST(floor(x1) AS INTEGER) + 1)) AS gx FROM box)),
  met AS (SELECT lat, lon, polygon_id FROM p JOIN grid ON gx = CAST(floor(lon) AS INTEGER) AND gy = CAST(floor(lat) AS INTEGER)),
  outer_hit AS (SELECT p.lat, p.lon, trim(country) AS country, polygon_id, holes FROM (SELECT met.lat, met.lon, box.* FROM met JOIN box USING (polygon_id) WHERE met.lat BETWEEN y0 AND y1 AND met.lon BETWEEN x0 AND x1) p WHERE {_odd_sql('p.ring')}),
  hole AS (SELECT p.lat, p.lon, p.polygon_id FROM (SELECT *, unnest(holes) AS h FROM outer_hit) p WHERE {_odd_sql('h')}),
  inside AS (SELECT lat, lon, country, polygon_id FROM outer_hit ANTI JOIN hole USING (lat, lon, polygon_id))"""


@query(f"WITH {_INSIDE} SELECT * FROM inside")
def containing_polygons(spark: SparkSession, d: str) -> DataFrame:
    return regions.containing_polygons(_lib(spark, d, *POSITION).select("lat", "lon"), table(spark, d, "boundaries"))


@query(f"""WITH {_INSIDE}, g AS (SELECT lat, lon, list_sort(list(DISTINCT country)) AS c FROM inside GROUP BY 1, 2)
SELECT p.lat, p.lon, c[1] AS country, coalesce(array_to_string(c, ','), '') AS candidates, c IS NULL AS is_ocean, coalesce(len(c) > 1, false) AS is_border FROM p LEFT JOIN g ON p.lat = g.lat AND p.lon = g.lon""")
def country_lookup(spark: SparkSession, d: str) -> DataFrame:
    return regions.country_lookup(_lib(spark, d, *POSITION).select("lat", "lon"), table(spark, d, "boundaries")).withColumn("candidates", F.array_join("candidates", ","))


@query("""SELECT country, polygon_id, list_min(list_transform(ring, lambda q: q.lat)) AS min_lat, list_min(list_transform(ring, lambda q: q.lon)) AS min_lon,
  list_max(list_transform(ring, lambda q: q.lat)) AS max_lat, list_max(list_transform(ring, lambda q: q.lon)) AS max_lon FROM boundaries""")
def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "boundaries").select("country", "polygon_id", F.inline(F.array(geo.bounding_box(F.col("ring")))))


_PICK = """g{n} AS (SELECT lat, lon, arg_min(name, (round(km, 6), place_id)) AS district, arg_min(name, (round(km, 6), place_id)) FILTER (kind >= 2) AS city, arg_min(coalesce(admin1, chr(0)), (round(km, 6), place_id)) AS state,
  arg_min(coalesce(country, chr(0)), (round(km, 6), place_id)) AS country FROM {source} GROUP BY 1, 2)"""
_NEAR_COUNTRY = "near.country = own.country"


@query(f"""WITH {_near_sql("'P'", '< 50')}, {_INSIDE.removeprefix(LIB + ', ')},
  own AS (SELECT lat, lon, min(country) AS country FROM inside GROUP BY 1, 2), strict AS (SELECT near.* FROM near JOIN own ON near.lat = own.lat AND near.lon = own.lon WHERE {_NEAR_COUNTRY}),
  {_PICK.format(n=1, source='near')}, {_PICK.format(n=2, source='strict')}
SELECT g1.lat, g1.lon, {', '.join(f"nullif(CASE WHEN g2.lat IS NULL THEN g1.{c} ELSE g2.{c} END, chr(0)) AS {c}" for c in ('district', 'city', 'state', 'country'))} FROM g1 LEFT JOIN g2 ON g1.lat = g2.lat AND g1.lon = g2.lon""")
def boundary_geocode(spark: SparkSession, d: str) -> DataFrame:
    points = _lib(spark, d, *POSITION).select("lat", "lon")
    countries = regions.country_lookup(points, table(spark, d, "boundaries")).select("lat", "lon", "country")
    return geocode.reverse_geocode(points, geocode.place_index(table(spark, d, "places")), countries=countries)


@query(f"""WITH box AS (SELECT *, {_EXTENT} FROM boundaries),
  c AS (SELECT polygon_id, x, unnest(range(greatest(CAST(floor((y0 + 90) / 180 * 128) AS BIGINT), 0), least(CAST(floor((y1 + 90) / 180 * 128) AS BIGINT), 127) + 1)) AS y FROM
    (SELECT polygon_id, y0, y1, unnest(range(greatest(CAST(floor((x0 + 180) / 360 * 256) AS BIGINT), 0), least(CAST(floor((x1 + 180) / 360 * 256) AS BIGINT), 255) + 1)) AS x FROM box)),
  s AS (SELECT polygon_id, x, y, (y + dy) * 1.40625::DOUBLE - 90 AS lat, (x + dx) * 1.40625::DOUBLE - 180 AS lon FROM c, (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.5)) v(dy, dx)),
  h AS (SELECT p.* FROM (SELECT s.*, trim(country) AS country, ring, holes FROM s JOIN boundaries USING (polygon_id)) p WHERE {_odd_sql('p.ring')}),
  o AS (SELECT p.polygon_id, p.x, p.y, p.lat, p.lon FROM (SELECT *, unnest(holes) AS h FROM h) p WHERE {_odd_sql('h')}),
  k AS (SELECT x, y, list_sort(list(DISTINCT country)) AS c FROM h ANTI JOIN o USING (polygon_id, x, y, lat, lon) GROUP BY 1, 2)
SELECT x, y, array_to_string(c, ',') AS countries, len(c) > 1 AS is_border FROM k""")
def cell_countries(spark: SparkSession, d: str) -> DataFrame:
    return regions.cell_countries(table(spark, d, "boundaries")).withColumn("countries", F.array_join("countries", ","))


@query(f"""WITH {LIB}, p AS (SELECT DISTINCT lat, lon FROM lib WHERE {USABLE}),
  e AS (SELECT polygon_id, ring[i].lon AS x1, ring[i].lat AS y1, ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END].lon AS x2, ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END].lat AS y2 FROM (SELECT polygon_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM boundaries WHERE len(ring) >= 3)),
  t AS (SELECT polygon_id, x1 + turn AS x1, y1, x2 + turn AS x2, y2 FROM e, (VALUES (-360.0::DOUBLE), (0.0), (360.0)) v(turn)),
  g AS (SELECT * EXCLUDE (gy0, gy1), unnest(range(gy0, gy1 + 1)) AS gy FROM (SELECT *, CAST(floor(least(y1, y2) - 0.051) AS INTEGER) AS gy0, CAST(floor(greatest(y1, y2) + 0.051) AS INTEGER) AS gy1,
    unnest(range(CAST(floor(least(x1, x2) - 0.051) AS INTEGER), CAST(floor(greatest(x1, x2) + 0.051) AS INTEGER) + 1)) AS gx FROM t)),
  m AS (SELECT lat, lon, polygon_id, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM p JOIN g ON gx = CAST(floor(lon) AS INTEGER) AND gy = CAST(floor(lat) AS INTEGER)),
  a AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest(((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS f FROM m)
SELECT DISTINCT lat, lon, polygon_id FROM a WHERE sqrt(pow(lon - (x1 + f * dx), 2) + pow(lat - (y1 + f * dy), 2)) < 0.05""")
def edge_points(spark: SparkSession, d: str) -> DataFrame:
    return regions.edge_points(_lib(spark, d, *POSITION).select("lat", "lon"), table(spark, d, "boundaries"), 0.05)


@query()
def prune_nearby(spark: SparkSession, d: str) -> DataFrame:
    return geocode.prune_nearby(geocode.place_index(table(spark, d, "places"), classes=("P",))).select("place_id", "kind")


@query()
def simplified_rings(spark: SparkSession, d: str) -> DataFrame:
    return regions.simplified(table(spark, d, "boundaries")).select("country", "polygon_id", F.posexplode("ring").alias("at", "p")).select("country", "polygon_id", "at", "p.lat", "p.lon")


@query(f"""WITH {LIB}, pts AS (SELECT DISTINCT lat, lon FROM lib WHERE {USABLE}),
  pl AS (SELECT place_id, lat AS plat, lon AS plon, {_KIND} AS kind, unnest([CAST(floor(lat) AS INTEGER) - 1, CAST(floor(lat) AS INTEGER), CAST(floor(lat) AS INTEGER) + 1]) AS band FROM places WHERE {USABLE} AND feature_class = 'P'),
  km AS (SELECT lat, lon, place_id, kind, {_haversine_sql('lat', 'lon', 'plat', 'plon')} AS km FROM pts JOIN pl ON band = CAST(floor(lat) AS INTEGER))
SELECT lat, lon, arg_min(place_id, (round(km, 6), place_id)) AS any_id, arg_min(place_id, (round(km, 6), place_id)) FILTER (kind >= 2) AS city_id FROM km WHERE km < 50 GROUP BY 1, 2""")
def nearest_place_complete(spark: SparkSession, d: str) -> DataFrame:
    got = geocode.nearest_places(_lib(spark, d, *POSITION).select("lat", "lon"), geocode.place_index(table(spark, d, "places")), ring=None)
    return got.select("lat", "lon", "any_id", "city_id")


@query(f"""SELECT place_id, y * 180 / 1024.0::DOUBLE - 90 AS min_lat, x * 360 / 1024.0::DOUBLE - 180 AS min_lon, (y + 1) * 180 / 1024.0::DOUBLE - 90 AS max_lat, (x + 1) * 360 / 1024.0::DOUBLE - 180 AS max_lon,
  substr(g, 1, 1) || ',' || substr(g, 1, 2) || ',' || substr(g, 1, 3) AS ancestors FROM (SELECT place_id, least(CAST(floor((lon + 180) / 360 * 1024) AS BIGINT), 1023) AS x, least(CAST(floor((lat + 90) / 180 * 1024) AS BIGINT), 1023) AS y,
  {_geohash_sql('lat', 'lon', 4)} AS g FROM places WHERE {USABLE})""")
def cells_of_places(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "places").where(enrich.has_coordinates(F.col("lat"), F.col("lon")))
    box = geo.cell_bounds(geo.cell_x(F.col("lon"), 4), geo.cell_y(F.col("lat"), 4), 4)
    return rows.select("place_id", F.inline(F.array(box)), F.array_join(geo.ancestors(geo.geohash(F.col("lat"), F.col("lon"), 4)), ",").alias("ancestors"))


@query("SELECT p.place_id, coalesce(a.name, p.admin1) AS admin1, coalesce(b.name, p.country) AS country_name FROM places p LEFT JOIN (SELECT country, admin1, min(name) AS name FROM admin1_codes GROUP BY 1, 2) a ON a.country = p.country AND a.admin1 = p.admin1 LEFT JOIN (SELECT upper(trim(country)) AS code, min(name) AS name FROM boundaries WHERE country IS NOT NULL GROUP BY 1) b ON b.code = upper(trim(p.country))")
def place_names(spark: SparkSession, d: str) -> DataFrame:
    named = geocode.admin_names(table(spark, d, "places"), table(spark, d, "admin1_codes"), "country", "admin1")
    return geocode.with_country_name(named, geocode.country_names(table(spark, d, "boundaries")), F.col("country")).select("place_id", "admin1", "country_name")


# --- enrichment from sidecars, masks, related paths -----------------------------------------------------


@query(f"""WITH {LIB}, s AS (SELECT *, CAST(file_id % 90 AS DOUBLE) AS sla, CAST(file_id % 180 AS DOUBLE) AS slo, {USABLE} AS mine FROM lib)
SELECT file_id, epoch_us(coalesce(taken, created)) AS taken_us, CASE WHEN NOT mine AND NOT (sla = 0 AND slo = 0) THEN sla ELSE lat END AS lat, CASE WHEN NOT mine AND NOT (sla = 0 AND slo = 0) THEN slo ELSE lon END AS lon FROM s""")
def sidecar_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _lib(spark, d, "taken", "created", *POSITION)
    side = rows.withColumns({"side_taken": F.col("created"), "side_lat": (F.col("file_id") % 90).cast("double"), "side_lon": (F.col("file_id") % 180).cast("double")})
    return enrich.merge_sidecar(side).select("file_id", F.unix_micros("taken").alias("taken_us"), "lat", "lon")


@query(f"WITH {LIB} SELECT file_id, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS county, location.state AS state, location.country AS country FROM lib")
def masked_location(spark: SparkSession, d: str) -> DataFrame:
    values = template.location_values(F.col("location"), Settings(granularity="state"))
    return _lib(spark, d, "location").select("file_id", *[values[v].alias(v) for v in ("city", "county", "state", "country")])


@query(f"WITH {LIB} SELECT file_id, epoch_us(timezone('America/New_York', {TS})) AS ts_us FROM lib")
def timezone_local(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.enriched(_lib(spark, d, *enrich.ENRICHED_FROM), Settings(zone_mode="local", zone="America/New_York"))
    return rows.select("file_id", F.unix_micros("ts").alias("ts_us"))


@query(f"""WITH {LIB} SELECT m.file_id AS main_id, r.file_id AS related_id FROM lib m JOIN lib r ON m.dir = r.dir AND lower(m.path) <> lower(r.path) AND starts_with(lower(r.stem), lower(m.stem)) AND (m.stem <> '' OR r.stem = '')""")
def related_files_loose(spark: SparkSession, d: str) -> DataFrame:
    return joins.related_files(_lib(spark, d, "path", "dir", "name", "stem"), "loose")


_STEM, _EXT = "regexp_replace({0}, '\\.[^.]*$', '')", "regexp_extract({0}, '(\\.[^.]*)$', 1)"


@query(f"""WITH {LIB}, r AS ({ORACLE_SQL['related_files'].removeprefix(f'WITH {LIB} ')}), n AS (SELECT main_id, related_id, a.name AS m, b.name AS o, '/out/' || {_STEM.format('a.name')} || '-1' || {_EXT.format('a.name')} AS dest FROM r JOIN lib a ON a.file_id = main_id JOIN lib b ON b.file_id = related_id)
SELECT main_id, related_id, CASE WHEN o = m || {_EXT.format('o')} THEN dest || {_EXT.format('o')}
  ELSE '/out/' || {_STEM.format("regexp_extract(dest, '([^/]*)$', 1)")} || CASE WHEN starts_with({_STEM.format('o')}, {_STEM.format('m')}) THEN substr({_STEM.format('o')}, length({_STEM.format('m')}) + 1) ELSE '' END || {_EXT.format('o')} END AS destination FROM n""")
def related_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = _lib(spark, d, "path", "dir", "name", "stem")
    m, r = rows.select(F.col("file_id").alias("main_id"), F.col("name").alias("m")), rows.select(F.col("file_id").alias("related_id"), F.col("name").alias("o"))
    pairs = joins.related_files(rows, "strict").join(m, "main_id").join(r, "related_id")
    main = F.concat(F.lit("/out/"), text.file_stem(F.col("m")), F.lit("-1"), text.file_extension(F.col("m")))
    return pairs.select("main_id", "related_id", joins.related_destination(F.col("m"), main, F.col("o")).alias("destination"))


@query(f"""WITH {LIB} SELECT file_id, CASE WHEN length < 0 THEN '0 B' WHEN length < 1024 THEN format('{{:,}} B', length) ELSE CASE """ + " ".join(f"WHEN length >= {1024**i} THEN format('{{:,.1f}} {u}', length / {1024**i}.0::DOUBLE)" for i, u in ((5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))) + """ END END AS size_text FROM lib WHERE length IS NOT NULL""")
def format_bytes_report(spark: SparkSession, d: str) -> DataFrame:
    return _lib(spark, d, "length").where("length is not null").select("file_id", text.format_bytes_report(F.col("length")).alias("size_text"))


@query("SELECT place_id, CASE WHEN place_id % 3 = 0 THEN population / 10.0::DOUBLE WHEN place_id % 3 = 1 THEN CAST(population AS DOUBLE) END AS metres FROM places WHERE population IS NOT NULL")
def xmp_altitude(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "places").where("population is not null")
    n = F.col("population").cast("string")
    made = F.when(F.col("place_id") % 3 == 0, F.concat(n, F.lit("/10"))).when(F.col("place_id") % 3 == 1, n).otherwise(F.concat(n, F.lit("/0")))
    return rows.select("place_id", coordinates.xmp_altitude(made).alias("metres"))


@query(f"WITH {LIB} SELECT file_id, epoch_us(date_trunc('second', taken)) AS taken_us FROM lib WHERE taken IS NOT NULL")
def xmp_date(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("file_id") % 2 == 0, F.date_format("taken", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("taken", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return _lib(spark, d, "taken").where("taken is not null").select("file_id", F.unix_micros(times.sidecar_date(made)).alias("taken_us"))


@query(f"WITH {LIB} SELECT file_id, '/d/' || regexp_extract(dir, '^/vault/?(.*)$', 1) || '/' || name AS destination FROM lib")
def directory_path(spark: SparkSession, d: str) -> DataFrame:
    settings = Settings(source=ROOT, destination="/d/{directory}/{name}{ext}")
    return organise.destinations(_lib(spark, d, *enrich.ENRICHED_FROM, "path", "dir", "name", "stem", "location"), settings).select("file_id", "destination")


# --- state --------------------------------------------------------------------------------------------

_OPS = """ops AS (SELECT entry_id AS file_index, CASE WHEN checksum IS NULL THEN 'Failed' WHEN file_size % 7 = 0 THEN 'Skipped' WHEN file_size % 5 = 0 THEN 'CopyDonePendingDelete' ELSE 'Completed' END AS result, file_size, accepted_at AS ts,
  source_path, destination_path, CASE WHEN batch_no % 2 = 0 THEN 'Move' ELSE 'Copy' END AS operation
  FROM processed_files {} QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY accepted_at DESC) = 1)"""
_OPS_SQL = _OPS.format("")
#: The log of a run that was cut off in its fourth batch, which is what there is to resume.
CUT_OFF = "batch_no <= 3"


def _operations(spark: SparkSession, d: str, upto: str = "true") -> DataFrame:
    rows = table(spark, d, "processed_files").where(upto)
    one = rows.groupBy("entry_id").agg(F.max(F.struct("accepted_at", "batch_no", "checksum", "file_size", "source_path", "destination_path")).alias("m")).select("entry_id", "m.*")
    result = F.when(F.col("checksum").isNull(), "Failed").when(F.col("file_size") % 7 == 0, "Skipped").when(F.col("file_size") % 5 == 0, "CopyDonePendingDelete").otherwise("Completed")
    return one.select(F.col("entry_id").alias("file_index"), result.alias("result"), "file_size", F.col("accepted_at").alias("ts"), "source_path", "destination_path", F.when(F.col("batch_no") % 2 == 0, "Move").otherwise("Copy").alias("operation"))


@query(f"WITH {_OPS.format('WHERE ' + CUT_OFF)} SELECT DISTINCT entry_id AS file_index FROM processed_files WHERE entry_id NOT IN (SELECT file_index FROM ops WHERE result IN ('Completed', 'CopyDonePendingDelete'))")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "processed_files").select(F.col("entry_id").alias("file_index")).distinct()
    return state.pending(plan, _operations(spark, d, CUT_OFF))


@query(f"""WITH {_OPS_SQL} SELECT count(*) FILTER (result IN ('Completed', 'CopyDonePendingDelete')) AS completed, count(*) FILTER (result = 'Failed') AS failed, count(*) FILTER (result = 'Skipped') AS skipped,
  CAST(coalesce(sum(file_size) FILTER (result IN ('Completed', 'CopyDonePendingDelete')), 0) AS BIGINT) AS bytes_done, max(epoch_us(ts)) AS latest_us FROM ops""")
def checkpoint_statistics(spark: SparkSession, d: str) -> DataFrame:
    return state.checkpoint_statistics(_operations(spark, d))


@query(f"WITH {_OPS_SQL} SELECT -file_index AS step, CASE WHEN operation = 'Move' THEN 'move_back' ELSE 'delete' END AS action, destination_path AS from_path, CASE WHEN operation = 'Move' THEN source_path END AS to_path FROM ops")
def rollback_operations(spark: SparkSession, d: str) -> DataFrame:
    return state.inverse_operations(_operations(spark, d).withColumnRenamed("file_index", "seq"))


@query(f"WITH {_OPS_SQL} SELECT DISTINCT regexp_replace(destination_path, '/[^/]*$', '') AS dir FROM ops")
def rollback_folders(spark: SparkSession, d: str) -> DataFrame:
    return state.directories_to_remove(_operations(spark, d).select(text.dir_name(F.col("destination_path")).alias("dir")))


@query(f"""WITH {_OPS_SQL} SELECT file_index, result, count(*) OVER w AS done, CAST(sum(file_size) OVER w AS BIGINT) AS done_bytes, round(100.0 * count(*) OVER w / count(*) OVER (PARTITION BY result), 1) AS percent FROM ops WINDOW w AS (PARTITION BY result ORDER BY file_index ROWS UNBOUNDED PRECEDING)""")
def running_progress(spark: SparkSession, d: str) -> DataFrame:
    return reports.running_progress(_operations(spark, d), "result", "file_index", "file_size").select("file_index", "result", "done", "done_bytes", "percent")


@query("SELECT scan_id, source_root FROM scan_runs WHERE source_root = '/vault/s0000003' AND zone_id IS NOT NULL ORDER BY started_at DESC, scan_id DESC LIMIT 1")
def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "scan_runs").select(F.col("scan_id").alias("session"), F.col("source_root").alias("source"), F.lit("/library").alias("destination"), F.when(F.col("zone_id").isNotNull(), "InProgress").otherwise("Completed").alias("status"), F.col("started_at").alias("started"))
    return state.latest_checkpoint(runs, "/vault/s0000003", "/library").select(F.col("session").alias("scan_id"), F.col("source").alias("source_root"))


_SUMS = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0) AS BIGINT) AS s{i}" for i in range(8))


@query(f"""WITH {LIB}, h AS (SELECT sha256(length(path) || '|' || lower(path) || '|' || coalesce(length, -1)) AS h FROM lib), s AS (SELECT count(*) AS files, {_SUMS} FROM h)
SELECT sha256(concat_ws('|', files, s0, s1, s2, s3, s4, s5, s6, s7)) AS hash, files FROM s""")
def plan_hash(spark: SparkSession, d: str) -> DataFrame:
    return state.plan_hash(_lib(spark, d, "path", "length"))


@query(f"WITH {LIB} SELECT path, old_length, length AS new_length FROM lib JOIN (SELECT full_path, max(size) - max(size) % 1024 AS old_length FROM scan_results GROUP BY 1) ON path = full_path WHERE length IS DISTINCT FROM old_length ORDER BY path LIMIT 10")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    recorded = table(spark, d, "scan_results").groupBy(F.col("full_path").alias("path")).agg((F.max("size") - F.max("size") % 1024).alias("length"))  # recorded in whole kilobytes
    return state.changed_files(_lib(spark, d, "path", "length").select("path", "length"), recorded)
