"""Intermediate tables in the folder all executors share.

Lineage is cut by writing parquet under ``spark.checkpoint.dir`` and reading it back: the files survive
the loss of an executor, and a reader can prune columns, which ``checkpoint()`` cannot. Only where that
setting is unset and the master is local (tests) does this module choose a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
#: Paths of intermediate tables by application, to be deleted when it ends.
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the session; raises on a cluster that names none."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="framelake-")
        atexit.register(_remove_local, _own[app])
    return "file://" + _own[app]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table, deleted when the application ends or by :func:`clean`."""
    path = f"{shared_folder(spark)}/framelake/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_clean_at_end, spark, app)
    _made[app].append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete this application's intermediate tables, when no frame that reads them is needed any more; how many."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    count = len(paths)
    while paths:
        drop_path(spark, paths.pop())
    return count


def _clean_at_end(spark: SparkSession, app: str) -> None:
    """At the end of the process, if its session is still there; a stopped one leaves its folder to the cluster."""
    try:
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
            clean(spark)
    except Exception:  # noqa: BLE001 - nothing is lost but the space, and the process is ending
        pass


def write_table(df: DataFrame, label: str, mode: str = "errorifexists") -> DataFrame:
    """Write a frame to the shared folder and return the frame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
