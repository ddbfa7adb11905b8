"""What a plan does to the world: copies, moves, logs."""

from __future__ import annotations

import errno
import os
import shutil
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import dir_name
from framelake.operators.filters import safe_input_path, safe_path
from framelake.session import ship_package

RETRIES = 3
#: Errors that may pass by themselves.
TRANSIENT = (errno.EAGAIN, errno.EBUSY, errno.EINTR, errno.ETIMEDOUT, errno.EIO)

RESULT = "file_index bigint, result string, error string, file_size bigint"


def with_retries(action, attempts: int = RETRIES, pause: float = 0.1):
    """Run an action again after a transient error, waiting longer each time."""
    for attempt in range(1, attempts + 1):
        try:
            return action()
        except OSError as error:
            if attempt == attempts or error.errno not in TRANSIENT:
                raise
            time.sleep(pause * attempt)


def link_within(path: str, root: str) -> str | None:
    """The first part of a path below ``root`` that is a symbolic link; None where there is none."""
    at = root.rstrip("/")
    for part in os.path.relpath(path, at or "/").split("/"):
        at = f"{at}/{part}"
        if os.path.islink(at):
            return at
    return None


def transfer(source: str, destination: str, move: bool, root: str | None = None) -> None:
    """Copy or move one file: written beside its destination first, then renamed, so it is there whole or not.

    Symbolic links are refused: the source itself, and with ``root`` any part of the destination below it.
    """
    linked = source if os.path.islink(source) else link_within(destination, root) if root else None
    if linked:
        raise OSError(errno.ELOOP, "symbolic link", linked)
    os.makedirs(os.path.dirname(destination), exist_ok=True)
    partial = f"{destination}.{os.getpid()}.part"
    try:
        shutil.copy2(source, partial)
        os.replace(partial, destination)
    finally:
        if os.path.exists(partial):
            os.remove(partial)
    if move:
        os.remove(source)


def execute(plan: DataFrame, root: str, move: bool = False, parallelism: int | None = None, dry_run: bool = True) -> DataFrame:
    """``file_index, result, error, file_size`` of a plan ``file_index, path, resolved, length``.

    A dry run changes nothing and reports ``Planned``. Rows with unsafe paths and rows whose transfer fails
    are ``Failed`` with the error; the others go on. A task that runs again finds finished copies of the
    same size and counts them as completed. The file system must be one that all executors share. The files are
    spread over ``parallelism`` tasks, by default the session's shuffle partitions.
    """
    safe = safe_path(F.col("resolved"), root) & safe_input_path(F.col("path"))
    checked = plan.select("file_index", "path", "resolved", F.coalesce("length", F.lit(0)).alias("length"), safe.alias("safe"))
    if dry_run:
        return checked.select("file_index", F.when(F.col("safe"), "Planned").otherwise("Failed").alias("result"), F.when(~F.col("safe"), "unsafe path").alias("error"), F.col("length").alias("file_size"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                result, error = "Completed", None
                try:
                    if not r.safe:
                        raise ValueError("unsafe path")
                    done = os.path.exists(r.resolved) and (not os.path.exists(r.path) or (not move and os.path.getsize(r.resolved) == os.path.getsize(r.path)))
                    if not done:
                        with_retries(lambda r=r: transfer(r.path, r.resolved, move, root))
                except (OSError, ValueError) as problem:
                    result, error = "Failed", str(problem)
                rows.append((r.file_index, result, error, r.length))
            yield pd.DataFrame(rows, columns=["file_index", "result", "error", "file_size"])

    ship_package(plan.sparkSession)
    return checked.repartition(parallelism or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, RESULT)


def undo(steps: DataFrame, root: str, source_root: str) -> DataFrame:
    """``step, result, error`` of the steps of ``state.inverse_operations``: moves go back, copies are deleted.

    What is already undone counts as done. Steps with paths outside the two roots fail, the others go on.
    """
    safe = safe_path(F.col("from_path"), root) & (F.col("to_path").isNull() | safe_path(F.col("to_path"), source_root)) & (F.col("action") != "invalid")
    checked = steps.select("step", "action", "from_path", "to_path", safe.alias("safe"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                result, error = "Undone", None
                try:
                    if not r.safe:
                        raise ValueError("unsafe path")
                    if r.action == "move_back" and os.path.exists(r.from_path):
                        if os.path.exists(r.to_path):
                            raise OSError(errno.EEXIST, "the source is there again", r.to_path)
                        with_retries(lambda r=r: transfer(r.from_path, r.to_path, True, source_root))
                    elif r.action == "move_back" and not os.path.exists(r.to_path):
                        raise OSError(errno.ENOENT, "neither place has the file", r.from_path)
                    elif r.action == "delete" and os.path.exists(r.from_path):
                        with_retries(lambda r=r: os.remove(r.from_path))
                except (OSError, ValueError) as problem:
                    result, error = "Failed", str(problem)
                rows.append((r.step, result, error))
            yield pd.DataFrame(rows, columns=["step", "result", "error"])

    ship_package(steps.sparkSession)
    return checked.repartition(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, "step bigint, result string, error string")


def _below(operations: DataFrame, root: str) -> DataFrame:
    """The folders under ``root`` that hold destinations or lead to them, with their depth."""
    relative = F.split(F.substring(dir_name(F.col("destination_path")), len(root.rstrip("/")) + 2, 1 << 20), "/")
    inside = operations.where(dir_name(F.col("destination_path")).startswith(root.rstrip("/") + "/")).select(relative.alias("parts")).distinct()
    each = inside.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    return each.select(F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).alias("dir"), "depth").distinct()


def folder_depths(operations: DataFrame, root: str) -> list[int]:
    """How deep the folders of destinations lie, the deepest first."""
    return sorted((r["depth"] for r in _below(operations, root).select("depth").distinct().collect()), reverse=True)


def folders_at(operations: DataFrame, root: str, depth: int) -> DataFrame:
    return _below(operations, root).where(F.col("depth") == depth).select("dir")


def remove_empty(folders: DataFrame) -> DataFrame:
    """``dir, removed`` of folders; one that isn't empty stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            removed = []
            for folder in pdf["dir"]:
                try:
                    os.rmdir(folder)
                    removed.append(True)
                except OSError:
                    removed.append(False)
            yield pdf[["dir"]].assign(removed=removed)

    return folders.mapInPandas(run, "dir string, removed boolean")
