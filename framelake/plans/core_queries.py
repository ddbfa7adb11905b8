"""Queries of the large-scale data-preparation operators that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import hot_keys, record_parser, spatial_join, timestamps
from framelake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.hot_keys(hot_keys.key_totals(table(spark, d, "files"), table(spark, d, "boundaries")))


def p1_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.key_totals(table(spark, d, "files"), table(spark, d, "boundaries"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.file_surroundings(table(spark, d, "files"), table(spark, d, "places"), table(spark, d, "boundaries"))


def _parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = record_parser.split_lines(table(spark, d, "gazetteer_raw"))
    return record_parser.classify(lines, table(spark, d, "feature_codes"), table(spark, d, "admin1_codes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return record_parser.faults(_parsed_lines(spark, d))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return record_parser.records(_parsed_lines(spark, d)).withColumn("modification_date", F.col("modification_date").cast("string"))


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The lines and records of each file: every line belongs to one record, and every validated start begins one."""
    parsed = record_parser.parse_files(table(spark, d, "gazetteer_raw"))
    return parsed.groupBy("file_name").agg(F.sum("n_lines").alias("n_lines"), F.count_if(F.col("syntax_error").isNull() & (F.col("n_fields") >= len(record_parser.FIELDS)) & F.get("fields", F.lit(0)).rlike(r"\A[0-9]+\z")).alias("sound"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised_records(spark, table(spark, d, "scan_results"), table(spark, d, "copy_snapshots"), table(spark, d, "scan_runs"))


QUERIES = {
    "p1_found": p1_found,
    "p1_key_totals": p1_key_totals,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p3_files": p3_files,
    "p4_found": p4_found,
}

_KEYS = """names AS (SELECT lower(trim(country)) AS s, min(trim(country)) AS code FROM boundaries GROUP BY 1 UNION ALL
    SELECT lower(trim(name)), min(trim(country)) FROM boundaries WHERE lower(trim(name)) NOT IN (SELECT lower(trim(country)) FROM boundaries) GROUP BY 1),
  lib AS (SELECT * FROM files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seen_at DESC NULLS LAST) = 1),
  k AS (SELECT coalesce(code, upper(trim(location.country))) AS country, nullif(lower(trim(location.city)), '') AS city, coalesce(length, 0) AS length
    FROM lib LEFT JOIN names ON s = lower(trim(location.country)) WHERE trim(location.country) <> ''),
  totals AS (SELECT 'country' AS key_kind, country, '' AS city, count(*) AS files, CAST(sum(length) AS BIGINT) AS total_length FROM k GROUP BY 2
    UNION ALL SELECT 'city', country, city, count(*), CAST(sum(length) AS BIGINT) FROM k WHERE city IS NOT NULL GROUP BY 2, 3)"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": f"WITH {_KEYS} SELECT key_kind, country, city FROM totals QUALIFY files >= 0.02 * sum(files) OVER (PARTITION BY key_kind)",
    "p1_key_totals": f"WITH {_KEYS} SELECT * FROM totals",
}

_USABLE = "lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)"
_NEXT = "{r}[CASE WHEN i = len({r}) THEN 1 ELSE i + 1 END]"


def _odd(ring: str) -> str:
    n = _NEXT.format(r=ring)
    return (
        f"len(list_filter(range(1, len({ring}) + 1), lambda i: (({ring}[i].lat > p.lat) <> ({n}.lat > p.lat))"
        f" AND p.lon < ({n}.lon - {ring}[i].lon) * (p.lat - {ring}[i].lat) / ({n}.lat - {ring}[i].lat) + {ring}[i].lon)) % 2 = 1"
    )


_A = "(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2))"
_EXTENT = "list_min(list_transform(ring, lambda v: v.lat)) AS y0, list_max(list_transform(ring, lambda v: v.lat)) AS y1, list_min(list_transform(ring, lambda v: v.lon)) AS x0, list_max(list_transform(ring, lambda v: v.lon)) AS x1"
ORACLE_SQL["p2_found"] = f"""WITH p AS (SELECT DISTINCT file_id, lat, lon FROM files WHERE file_id IS NOT NULL AND {_USABLE}),
  q AS (SELECT *, unnest([CAST(floor(lat) AS INTEGER) - 1, CAST(floor(lat) AS INTEGER), CAST(floor(lat) AS INTEGER) + 1]) AS band FROM places WHERE {_USABLE} AND population >= 1000),
  box AS (SELECT *, {_EXTENT} FROM boundaries),
  grid AS (SELECT polygon_id, gx, unnest(range(CAST(floor(y0) AS INTEGER), CAST(floor(y1) AS INTEGER) + 1)) AS gy FROM (SELECT polygon_id, y0, y1, unnest(range(CAST(floor(x0) AS INTEGER), CAST(floor(x1) AS INTEGER) + 1)) AS gx FROM box)),
  met AS (SELECT file_id, lat, lon, polygon_id FROM p JOIN grid ON gx = CAST(floor(lon) AS INTEGER) AND gy = CAST(floor(lat) AS INTEGER)),
  hit AS (SELECT p.file_id, p.lat, p.lon, p.polygon_id, p.holes FROM (SELECT met.*, ring, holes FROM met JOIN box USING (polygon_id) WHERE lat BETWEEN y0 AND y1 AND lon BETWEEN x0 AND x1) p WHERE {_odd('p.ring')}),
  hole AS (SELECT p.file_id, p.polygon_id FROM (SELECT *, unnest(holes) AS h FROM hit) p WHERE {_odd('h')})
SELECT file_id, 'near' AS match_kind, place_id AS match_id FROM p JOIN q ON band = CAST(floor(p.lat) AS INTEGER) AND abs(q.lat - p.lat) <= 0.02 WHERE 2 * 6371.0 * atan2(sqrt({_A}), sqrt(greatest(0, 1 - {_A}))) <= 2
UNION ALL SELECT file_id, 'inside', CAST(polygon_id AS BIGINT) FROM hit ANTI JOIN hole USING (file_id, polygon_id)"""

_QUOTED, _BARE = '"(?:[^"]|"")*"', '[^"\\t][^\\t]*|'
_FAULTS = f"""s AS (SELECT line_id, raw_line, regexp_full_match(raw_line, '(?s)(?:{_QUOTED}|{_BARE})(?:\\t(?:{_QUOTED}|{_BARE}))*') AS fine,
    list_transform(regexp_extract_all(raw_line || chr(9), '(?s)({_QUOTED}|[^\\t]*)\\t', 1), lambda f: CASE WHEN starts_with(f, '"') THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS f FROM gazetteer_raw),
  r AS (SELECT line_id, f, CASE WHEN NOT fine THEN 'quoting' WHEN len(f) <> 19 THEN 'columns'
    WHEN NOT regexp_full_match(f[5], '-?[0-9]{{1,3}}(\\.[0-9]+)?') OR abs(try_cast(f[5] AS DOUBLE)) > 90 THEN 'latitude'
    WHEN NOT regexp_full_match(f[6], '-?[0-9]{{1,3}}(\\.[0-9]+)?') OR abs(try_cast(f[6] AS DOUBLE)) > 180 THEN 'longitude'
    WHEN NOT EXISTS (SELECT 1 FROM feature_codes c WHERE c.feature_class = f[7] AND c.feature_code = f[8]) THEN 'feature_code'
    WHEN f[11] <> '' AND NOT EXISTS (SELECT 1 FROM admin1_codes a WHERE a.country = f[9] AND a.admin1 = f[11]) THEN 'state'
    WHEN f[15] <> '' AND NOT regexp_full_match(f[15], '[0-9]{{1,10}}') THEN 'population' END AS reason FROM s)"""
ORACLE_SQL["p3_found"] = f"WITH {_FAULTS} SELECT line_id, reason FROM r WHERE reason IS NOT NULL"


def _typed(i: int, name: str) -> str:
    text = f"rtrim(regexp_replace(f[{i}], '\\r$', ''), ' ')"
    whole = f"CASE WHEN regexp_full_match({text}, '\\s*[+-]?[0-9]+\\s*') THEN try_cast({text} AS {{}}) END"
    kinds = {"latitude": f"try_cast({text} AS DOUBLE)", "longitude": f"try_cast({text} AS DOUBLE)", "modification_date": f"CAST(try_cast({text} AS DATE) AS VARCHAR)"}
    kinds |= {n: whole.format("BIGINT") for n in ("population", "geonameid")} | {n: whole.format("INTEGER") for n in ("elevation", "dem")}
    return f"{kinds.get(name, f'f[{i}]')} AS {name}"


ORACLE_SQL["p3_records"] = f"WITH {_FAULTS} SELECT line_id, {', '.join(_typed(i, n) for i, n in enumerate(record_parser.FIELDS, 1))} FROM r WHERE reason IS NULL"
ORACLE_SQL["p3_files"] = f"""WITH l AS (SELECT file_name, line_no, min(coalesce(raw_line, '')) AS raw_line FROM gazetteer_raw WHERE file_name IS NOT NULL AND line_no IS NOT NULL GROUP BY 1, 2)
SELECT file_name, count(*) AS n_lines, count(*) FILTER (regexp_matches(raw_line, '^[0-9]+\\t') AND regexp_full_match(raw_line, '(?s)(?:{_QUOTED}|{_BARE})(?:\\t(?:{_QUOTED}|{_BARE}))*') AND
  len(regexp_extract_all(raw_line || chr(9), '(?s)({_QUOTED}|[^\\t]*)\\t', 1)) >= 19) AS sound FROM l GROUP BY 1"""
