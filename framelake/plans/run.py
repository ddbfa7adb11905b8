"""Runs of a plan that leave a log, can be resumed where they were cut off, and can be undone.

A session's plan is written down before anything is copied, so that a resumed run has the same destinations whatever
has been copied meanwhile. Operations are logged chunk by chunk; a chunk that was cut off is done again, which finds
finished copies as they are.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.config import Settings, settings_hash
from framelake.operators import filters, state
from framelake.operators.ranking import spread_rank
from framelake.operators.reports import remaining_seconds_of
from framelake.sources import logs, sinks

#: Files of one logged chunk; a run cut off repeats at most so many.
CHUNK_FILES = 100_000


def start(spark: SparkSession, plan: DataFrame, settings: Settings, folder: str, move: bool) -> dict:
    """A new session: its plan with ``file_index`` in the order of paths, and its header."""
    header = {
        "id": f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}", "started": datetime.now(UTC).isoformat(), "status": "InProgress", "dry_run": False, "move": move,
        "source": settings.source, "destination": settings.destination, "config_hash": settings_hash(settings),
    }
    ranked = spread_rank(plan.select(F.lit(1).alias("_all"), "file_id", "path", "resolved", "length").where("resolved is not null"), ["_all"], ["path", "file_id"], "file_index").drop("_all")
    logs.write_plan(ranked, folder, header["id"])
    header["total"] = logs.read_plan(spark, folder, header["id"]).count()
    logs.write_header(folder, header)
    return header


def carry_on(spark: SparkSession, folder: str, header: dict, chunk: int = CHUNK_FILES, progress=None) -> dict:
    """Do what a session's log doesn't show as done, chunk by chunk; returns the header with the results' counts."""
    plan, move = logs.read_plan(spark, folder, header["id"]), header["move"]
    root = filters.destination_root(header["destination"])
    began, done = time.monotonic(), 0
    for low in range(1, header["total"] + 1, chunk):
        part = plan.where(F.col("file_index").between(low, low + chunk - 1))
        left = state.pending(part, logs.read_operations(spark, folder, header["id"]).where(F.col("file_index").between(low, low + chunk - 1)))
        if left.limit(1).count():
            results = sinks.execute(left, root, move, dry_run=False)
            logged = results.join(left.select("file_index", "path", "resolved"), "file_index").select(
                F.lit(header["id"]).alias("session"), F.col("file_index").alias("seq"), "file_index", F.lit("Move" if move else "Copy").alias("operation"), "result",
                F.col("path").alias("source_path"), F.col("resolved").alias("destination_path"), "file_size", F.lit(None).cast("string").alias("checksum"), F.current_timestamp().alias("ts"),
            )
            logs.append_operations(logged, folder)
        done += min(chunk, header["total"] - low + 1)
        if progress:
            progress({"done": done, "total": header["total"], "seconds_left": remaining_seconds_of(done, header["total"], time.monotonic() - began)})
    latest = latest_results(logs.read_operations(spark, folder, header["id"]))
    counts = {r["result"]: r["count"] for r in latest.groupBy("result").count().collect()}
    header |= {"status": "Completed" if not counts.get("Failed") else "CompletedWithErrors", "ended": datetime.now(UTC).isoformat(), "results": counts}
    logs.write_header(folder, header)
    return header


def latest_results(operations: DataFrame) -> DataFrame:
    """Each operation once: a file that failed and was done by a later run counts as done."""
    good = F.col("result").isin(*state.DONE_RESULTS)
    row = F.struct(good.alias("good"), "ts", "result", "operation", "source_path", "destination_path", "file_size")
    return operations.groupBy("session", "file_index").agg(F.max(row).alias("m")).select("session", F.col("file_index").alias("seq"), "file_index", "m.*").drop("good")


def resumable(spark: SparkSession, folder: str, settings: Settings) -> tuple[dict | None, list[str], list[str]]:
    """(header, errors, warnings) of the unfinished session of the same folders that started last."""
    found = [h for h in logs.read_headers(folder) if h["status"] == "InProgress" and h["source"] == settings.source and h["destination"] == settings.destination]
    if not found:
        return None, [], []
    header = max(found, key=lambda h: (h["started"], h["id"]))
    checked = header | {"started": datetime.fromisoformat(header["started"])}
    return header, *state.checkpoint_problems(checked, settings.source, settings.destination, settings_hash(settings), datetime.now(UTC))


def roll_back(spark: SparkSession, folder: str, session: str) -> dict[str, int]:
    """Undo a session's completed operations, then remove the folders this leaves empty; counts by result.

    Steps touch different files, so they run side by side; folders go afterwards, the deepest first.
    """
    header = next((h for h in logs.read_headers(folder) if h["id"] == session), None)
    if header is None:
        raise ValueError(f"no session {session!r}")
    done = latest_results(logs.read_operations(spark, folder, session)).where(F.col("result").isin(*state.DONE_RESULTS))
    steps = state.inverse_operations(done)
    root = filters.destination_root(header["destination"])
    results = logs.write_undo(sinks.undo(steps, root, header["source"]), folder, session)
    counts = {r["result"]: r["count"] for r in results.groupBy("result").count().collect()}
    for depth in sinks.folder_depths(done, root):
        folders = state.directories_to_remove(sinks.folders_at(done, root, depth))
        sinks.remove_empty(folders).write.format("noop").mode("overwrite").save()
    logs.write_header(folder, header | {"status": "RolledBack", "undone": counts})
    return counts


def report(event: dict) -> None:
    """Progress as one line of JSON on the error output."""
    print(json.dumps(event), file=sys.stderr, flush=True)
