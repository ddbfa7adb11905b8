"""Operation logs and checkpoints as files.

A log folder has ``sessions`` (a JSON header for each run), ``plans`` (what each run set out to do), ``operations``
(what it did) and ``undone``. It must be one that the driver and all executors share.
"""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "id string, started timestamp, ended timestamp, status string, dry_run boolean, source string, destination string"
PLAN = "file_index bigint, file_id bigint, path string, resolved string, length bigint"
OPERATION = "session string, seq bigint, file_index bigint, operation string, result string, source_path string, destination_path string, file_size bigint, checksum string, ts timestamp"


def read_logs(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Transaction logs, the latest start first; files that cannot be read are left out."""
    raw = spark.read.schema(LOG).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(folder)
    return raw.where("id is not null").orderBy(F.desc("started"), "id")


def append_operations(operations: DataFrame, folder: str) -> None:
    """Append operations; Spark's commit makes each append visible as a whole."""
    columns = [c.split()[0] for c in OPERATION.split(", ")]
    operations.select(*columns).write.mode("append").partitionBy("session").parquet(f"{folder}/operations")


def read_operations(spark: SparkSession, folder: str, session: str | None = None) -> DataFrame:
    """The operations of one session or all; none where nothing was logged yet."""
    if not os.path.isdir(f"{folder}/operations"):
        return spark.createDataFrame([], OPERATION)
    df = spark.read.schema(OPERATION).parquet(f"{folder}/operations")
    return df if session is None else df.where(F.col("session") == session)


def write_plan(plan: DataFrame, folder: str, session: str) -> None:
    plan.select(*[c.split()[0] for c in PLAN.split(", ")]).write.parquet(f"{folder}/plans/{session}")


def read_plan(spark: SparkSession, folder: str, session: str) -> DataFrame:
    return spark.read.schema(PLAN).parquet(f"{folder}/plans/{session}")


def write_undo(results: DataFrame, folder: str, session: str) -> DataFrame:
    """What a rollback did, written as it is done once."""
    path = f"{folder}/undone/{session}"
    results.write.mode("overwrite").parquet(path)
    return results.sparkSession.read.schema(results.schema).parquet(path)


def write_header(folder: str, header: dict) -> None:
    """A session's header; written beside its place first, so a reader finds it whole."""
    path = f"{folder}/sessions/{header['id']}.json"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as held:
        json.dump(header, held)
    os.replace(f"{path}.part", path)


def read_headers(folder: str) -> list[dict]:
    """All sessions' headers, the latest start first; unreadable ones are left out."""
    found = []
    for path in glob.glob(f"{folder}/sessions/*.json"):
        try:
            with open(path, encoding="utf-8") as held:
                header = json.load(held)
            if isinstance(header, dict) and header.get("id"):
                found.append(header)
        except (OSError, ValueError):
            continue
    return sorted(found, key=lambda h: (h.get("started", ""), h["id"]), reverse=True)
