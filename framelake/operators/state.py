"""Runs that can be resumed and undone: operations logs, checkpoints, and what follows from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
DONE_RESULTS = ("Completed", "CopyDonePendingDelete")
MOST_AGE = timedelta(days=30)


def pending(plan: DataFrame, operations: DataFrame, key: str = "file_index") -> DataFrame:
    """Plan rows that no operation has completed; failed and skipped ones are tried again."""
    return plan.join(operations.where(F.col("result").isin(*DONE_RESULTS)).select(key).distinct(), key, "left_anti")


def checkpoint_statistics(operations: DataFrame) -> DataFrame:
    """One row: completed, failed, skipped operations, bytes of the completed, and the latest time."""
    done = F.col("result").isin(*DONE_RESULTS)
    return operations.agg(
        F.count_if(done).alias("completed"), F.count_if(F.col("result") == "Failed").alias("failed"), F.count_if(F.col("result") == "Skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(done, F.col("file_size"))), F.lit(0)).cast("bigint").alias("bytes_done"), F.max(F.unix_micros("ts")).alias("latest_us"),
    )


def plan_hash(plan: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """``hash, files``: a SHA-256 of the plan's paths (without case) and sizes, the same for any order.

    A file's hash is read as eight numbers, which are added up over all files; the sums are hashed. Adding
    combines on the map side, so no task sorts or gathers the plan, and repeated rows count.
    """
    line = F.concat_ws("|", F.length(path).cast("string"), F.lower(path), F.coalesce(F.col(size), F.lit(-1)).cast("string"))
    digest = F.sha2(line, 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    sums = plan.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(n), F.lit(0)).alias(f"_{i}") for i, n in enumerate(numbers)])
    return sums.select(F.sha2(F.concat_ws("|", "files", *[f"_{i}" for i in range(8)]), 256).alias("hash"), "files")


def latest_checkpoint(checkpoints: DataFrame, source: str, destination: str) -> DataFrame:
    """The unfinished checkpoint of the same source and destination that started last; none or one row."""
    same = (F.col("source") == source) & (F.col("destination") == destination) & (F.col("status") == "InProgress")
    return checkpoints.where(same).orderBy(F.desc("started"), F.desc("session")).limit(1)


def checkpoint_problems(checkpoint: dict, source: str, destination: str, config_hash: str, now: datetime, total: int | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of resuming a checkpoint; hashes are compared whole."""
    errors, warnings = [], []
    if checkpoint["source"].rstrip("/") != source.rstrip("/"):
        errors.append("another source")
    if checkpoint["destination"].rstrip("/") != destination.rstrip("/"):
        errors.append("another destination")
    if checkpoint["config_hash"] != config_hash:
        errors.append("other settings")
    if total is not None and checkpoint.get("completed", 0) >= total:
        errors.append("nothing left to do")
    if now - checkpoint["started"] > MOST_AGE:
        warnings.append(f"older than {MOST_AGE.days} days")
    return errors, warnings


def resume_decision(fresh: bool, checkpoint: dict | None, errors: list[str], resume: bool) -> str:
    """``fresh``, ``resume``, ``invalid`` or ``ask``, in the order the reasons outrank each other."""
    if fresh or checkpoint is None:
        return "fresh"
    if errors:
        return "invalid"
    return "resume" if resume else "ask"


def changed_files(plan: DataFrame, recorded: DataFrame, most: int = 10) -> DataFrame:
    """``path, old_length, new_length`` of up to ``most`` files whose size differs from the recorded one, by path."""
    old = recorded.select("path", F.col("length").alias("old_length"))
    differ = plan.select("path", F.col("length").alias("new_length")).join(old, "path").where(~F.col("old_length").eqNullSafe(F.col("new_length")))
    return differ.orderBy("path").limit(most).select("path", "old_length", "new_length")


def expired(checkpoints: DataFrame, now: datetime, age: timedelta = MOST_AGE) -> DataFrame:
    """Finished checkpoints older than ``age``, which a clean-up removes."""
    return checkpoints.where((F.col("status") != "InProgress") & (F.col("started") < F.lit(now - age)))


def inverse_operations(operations: DataFrame) -> DataFrame:
    """``step, action, from_path, to_path``: what undoes a log, the last operation first.

    A move goes back, a copy is deleted. Operations without usable paths become ``invalid``.
    """
    bad = F.coalesce(F.col("destination_path") == "", F.lit(True)) | F.array_contains(F.split("destination_path", r"[/\\]"), "..")
    action = F.when(bad, "invalid").when(F.lower("operation") == "move", "move_back").otherwise("delete")
    return operations.select((-F.col("seq")).alias("step"), action.alias("action"), F.col("destination_path").alias("from_path"), F.when(action == "move_back", F.col("source_path")).alias("to_path")).orderBy("step")


def directories_to_remove(created: DataFrame) -> DataFrame:
    """Created folders, the longest path first, to be removed where empty."""
    return created.select("dir").distinct().orderBy(F.desc(F.length("dir")), "dir")


def log_history(logs: DataFrame) -> DataFrame:
    """Logs by start, the latest first; unreadable ones (no id) are left out."""
    return logs.where("id is not null").orderBy(F.desc("started"), "id")
