"""Raw gazetteer lines into typed records and located faults."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.operators.lookup import lookup_join
from framelake.sources.delimited import NEWLINE, Grammar, parse_lines
from framelake.session import ship_package

#: The fields of a gazetteer line, in order.
FIELDS = (
    "geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country",
    "cc2", "admin1", "admin2", "admin3", "admin4", "population", "elevation", "dem", "timezone", "modification_date",
)
REASONS = ("quoting", "columns", "latitude", "longitude", "feature_code", "state", "population")

_DEGREES = r"\A-?[0-9]{1,3}(\.[0-9]+)?\z"
_PEOPLE = r"\A[0-9]{1,10}\z"
_SCHEMA = "line_id bigint, n_fields int, syntax_error string, error_line int, error_column int, fields array<string>"


def split_lines(raw: DataFrame, id_column: str = "line_id", text_column: str = "raw_line") -> DataFrame:
    """``line_id, n_fields, syntax_error, error_line, error_column, fields``: one row for each raw line.

    Each row's text is one record; a batch of rows is parsed as one text whose record starts are known, where the
    parser resumes after a broken quote. A null text has no fields (``n_fields`` 0); an empty text has one empty
    field; a newline within a text is data. Other columns are ignored, whatever their names.
    """
    ship_package(raw.sparkSession)
    width = len(FIELDS)
    out = pa.schema([("line_id", pa.int64()), ("n_fields", pa.int32()), ("syntax_error", pa.string()), ("error_line", pa.int32()), ("error_column", pa.int32()), ("fields", pa.list_(pa.string()))])

    def parse(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = iter(parse_lines([t for t in texts if t is not None], width))
            rows = [None if t is None else next(found) for t in texts]
            cols = [
                [0 if r is None else len(r.fields) for r in rows],
                [r and r.error for r in rows],
                [r and r.error_line for r in rows],
                [r and r.error_column for r in rows],
                [None if r is None or r.error else r.fields for r in rows],
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, [f.type for f in out][1:], strict=True)], schema=out)

    return raw.select(F.col(f"`{id_column}`").cast("bigint").alias("line_id"), F.col(f"`{text_column}`").alias("raw_line")).mapInArrow(parse, _SCHEMA)


_OF_FILE = "file_name string, first_line bigint, n_lines bigint, n_fields int, syntax_error string, error_line bigint, error_column int, fields array<string>"
#: Lines of a file that one group parses, up to the next record start.
BLOCK_LINES = 5_000


def parse_files(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Records of whole files given as rows ``file_name, line_no, raw_line``.

    One row a record: ``file_name, first_line, n_lines, n_fields, syntax_error, error_line, error_column, fields``. A
    record may span lines where a quoted field does. Where a quote is broken the parser resumes at the next line that
    looks like a record (a number and tabs enough); lines before that belong to the broken record, so every line of a
    file belongs to one record. As such a line always starts a record, files are cut at them into blocks of about
    ``block_lines`` lines, and a file of any size is parsed by many tasks; only a run of lines without any record start
    stays together. A line number that occurs twice counts once (the smallest text); lines without file or number are
    left out, null texts are empty lines.
    """
    ship_package(lines.sparkSession)
    width = len(FIELDS)
    rows = lines.where("file_name is not null and line_no is not null").groupBy("file_name", "line_no").agg(F.min(F.coalesce("raw_line", F.lit(""))).alias("raw_line"))
    starts = F.col("raw_line").rlike(r"\A[0-9]+\t") & (F.length("raw_line") - F.length(F.translate("raw_line", "\t", "")) >= width - 1)
    rows = rows.withColumns({"block": F.floor(F.col("line_no") / block_lines), "starts": starts})
    # Lines of a block before its first record start belong to the last block before it that has one.
    blocks = rows.groupBy("file_name", "block").agg(F.min(F.when(F.col("starts"), F.col("line_no"))).alias("first"))
    before = F.last(F.when(F.col("first").isNotNull(), F.col("block")), ignorenulls=True).over(W.partitionBy("file_name").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(-1)))  # one row for each block of lines
    own = F.when(F.col("line_no") >= F.col("first"), F.col("block")).otherwise(F.col("before"))
    placed = rows.join(blocks, ["file_name", "block"]).select("file_name", own.alias("part"), "line_no", "raw_line")

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no", kind="stable")
        number = pdf["line_no"].to_numpy()
        out = []
        for r in Grammar(NEWLINE.join(pdf["raw_line"]), width).records():
            out.append((pdf["file_name"].iloc[0], number[r.line - 1], r.lines, len(r.fields), r.error, r.error_line and number[r.error_line - 1], r.error_column, None if r.error else r.fields))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OF_FILE.split(", ")]).astype({"error_line": "Int64", "error_column": "Int32"})

    return placed.groupBy("file_name", "part").applyInPandas(parse, _OF_FILE)


def _degrees_fault(column: Column, limit: int) -> Column:
    return column.isNull() | ~column.rlike(_DEGREES) | (F.abs(column.try_cast("double")) > limit)


def classify(parsed: DataFrame, feature_codes: DataFrame, admin1_codes: DataFrame) -> DataFrame:
    """Adds ``reason`` (first fault of ``REASONS``, null for a good record) and the typed columns.

    Quoting outranks the number of fields, which outranks values; values are checked from left to right.
    The dimensions are compared exactly; rows of them with a null key match nothing. A record with a fault
    has null typed columns where its text has no value of the type.
    """
    at = {name: F.when(F.col("n_fields") == len(FIELDS), F.col("fields")[i]) for i, name in enumerate(FIELDS)}
    wide = parsed.select("line_id", "n_fields", "syntax_error", "error_line", "error_column", *[c.alias(n) for n, c in at.items()])
    codes = feature_codes.select("feature_class", "feature_code").dropna().distinct().withColumn("_known_code", F.lit(True))
    states = admin1_codes.select("country", "admin1").dropna().distinct().withColumn("_known_state", F.lit(True))
    wide = lookup_join(lookup_join(wide, codes, ["feature_class", "feature_code"]), states, ["country", "admin1"])
    reason = (
        F.when(F.col("syntax_error").isNotNull(), "quoting")
        .when(F.col("n_fields") != len(FIELDS), "columns")
        .when(_degrees_fault(F.col("latitude"), 90), "latitude")
        .when(_degrees_fault(F.col("longitude"), 180), "longitude")
        .when(F.col("_known_code").isNull(), "feature_code")
        .when((F.col("admin1") != "") & F.col("_known_state").isNull(), "state")
        .when((F.col("population") != "") & ~F.col("population").rlike(_PEOPLE), "population")
    )
    typed = {"latitude": "double", "longitude": "double", "population": "bigint", "elevation": "int", "dem": "int", "geonameid": "bigint", "modification_date": "date"}
    return wide.select(
        "line_id", reason.alias("reason"), "syntax_error", "error_line", "error_column", "n_fields",
        *[(F.rtrim(F.regexp_replace(n, r"\r\z", "")).try_cast(typed[n]) if n in typed else F.col(n)).alias(n) for n in FIELDS],
    )


def faults(parsed: DataFrame) -> DataFrame:
    """``line_id, reason`` of the records with a fault."""
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason")


def records(parsed: DataFrame) -> DataFrame:
    """The good records, typed."""
    return parsed.where(F.col("reason").isNull()).drop("reason", "syntax_error", "error_line", "error_column", "n_fields")
