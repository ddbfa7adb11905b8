"""Media files of a folder tree as rows."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import base_name, dir_name, file_extension, file_stem
from framelake.operators.filters import within_depth
from framelake.sources.exif import media_metadata


_EMPTY = "path string, modificationTime timestamp, length bigint, content binary"


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of length 0 under a folder of a shared POSIX file system, which the file source leaves out.

    The driver lists the folder itself; each folder in it is walked by a task.
    """
    base = root.removeprefix("file://")
    tops = [(e.path, e.is_dir(follow_symlinks=False)) for e in os.scandir(base)] if os.path.isdir(base) else []

    def walk(batches):
        for pdf in batches:
            found = []
            for top, is_folder in zip(pdf["path"], pdf["is_folder"], strict=True):
                for folder, _, names in os.walk(top) if is_folder else [(os.path.dirname(top), [], [os.path.basename(top)])]:
                    for name in names:
                        path = os.path.join(folder, name)
                        if os.path.isfile(path) and os.path.getsize(path) == 0:
                            found.append((path, pd.Timestamp(os.path.getmtime(path), unit="s"), 0, b""))
            yield pd.DataFrame(found, columns=["path", "modificationTime", "length", "content"]).astype({"modificationTime": "datetime64[us]", "length": "int64"})

    return spark.createDataFrame(tops, "path string, is_folder boolean").repartition(max(1, min(len(tops), 200))).mapInPandas(walk, _EMPTY)


def scan(spark: SparkSession, root: str, max_depth: int | None = None, content: bool = False) -> DataFrame:
    """``path, dir, name, stem, ext, length, modified`` (and ``content``) of all files under a folder.

    Listing is distributed by the file source; ``content`` isn't read from disk unless it is asked for. Files of length
    0, which that source leaves out, are added where the folder lies on a shared POSIX file system.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if "://" not in root or root.startswith("file://"):
        raw = raw.select("path", "modificationTime", "length", "content").unionByName(_empty_files(spark, root))
    path = F.regexp_replace("path", "^file:/*", "/")
    named = raw.withColumn("path", path).withColumns({"dir": dir_name(F.col("path")), "name": base_name(F.col("path"))})
    out = named.withColumns({"stem": file_stem(F.col("name")), "ext": file_extension(F.col("name"))})
    out = out.where(within_depth(F.col("path"), root.removeprefix("file://"), max_depth))
    return out.select("path", "dir", "name", "stem", "ext", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def with_checksum(files: DataFrame) -> DataFrame:
    """Adds the SHA-256 of the content, lower-case hexadecimal."""
    return files.withColumn("checksum", F.sha2("content", 256))


def with_metadata(files: DataFrame) -> DataFrame:
    """Adds ``meta`` (taken, lat, lon, make, model, description, album_xmp, album_iptc, album_xp) read once from each file's content."""
    return files.withColumn("meta", media_metadata(F.col("content")))
