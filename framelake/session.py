"""Session defaults and table access shared by queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "framelake", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings (dots as ``__``) override them."""
    builder = SparkSession.builder.master(master).appName(app)
    cores = master[6:-1] if master.startswith("local[") else ""
    settings = dict(DEFAULTS)
    if cores.isdigit():
        settings["spark.sql.shuffle.partitions"] = cores
        settings["spark.driver.memory"] = os.environ.get("FRAMELAKE_DRIVER_MEMORY", "8g")
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="framelake-code-")  # of the driver; executors fetch the file from it
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "framelake_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as held:
        for root, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(root, name)
                    held.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A parquet table of a data folder; timestamps without zone are read as UTC instants."""
    ship_package(spark)
    df = spark.read.parquet(f"{base}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df
