"""The organisation plan: every file's destination, and what the plan amounts to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.config import Settings
from framelake.functions.text import dir_name
from framelake.operators import collisions, filters, template
from framelake.operators.enrich import ENRICHED_FROM, enriched, library
from framelake.operators.geocode import country_names, with_country_name
from framelake.operators.joins import first_of_checksum, related_destination, related_files


def destinations(files: DataFrame, settings: Settings, boundaries: DataFrame | None = None) -> DataFrame:
    """Enriched files with ``rejection, is_valid, destination``; counts of conditions are over all files."""
    rows = enriched(files, settings)
    full = None
    if settings.full_country_names and boundaries is not None:
        rows, full = with_country_name(rows, country_names(boundaries), F.col("location.country")), F.col("country_name")
    levels = template.counted_levels(settings.destination)
    raw = template.location_values(F.col("location"), Settings(), None)
    rows = template.with_counts(rows, levels, raw)
    rules = filters.date_rules(F.col("ts"), settings.min_date, settings.max_date)
    if settings.exclude:
        rules.append(filters.exclude_rule(F.col("path"), settings.source, settings.exclude))
    rows = filters.validated(rows, rules)
    folder = F.when(F.lower("dir") == settings.source.rstrip("/").lower(), "").otherwise(filters.relative_path(F.col("dir"), settings.source))
    plain = template.plain_values(F.col("ts"), F.col("name"), F.col("stem"), F.col("ext"), folder)
    chained = template.location_values(F.col("location"), settings, full) | {"camera": F.col("camera"), "album": F.col("album")}
    counts = {v: F.col(f"_n_{v}") for v in levels}
    path = template.evaluate(settings.destination, plain, chained, settings, counts)
    return rows.withColumn("destination", path).drop(*[f"_n_{v}" for v in levels])


def plan(files: DataFrame, settings: Settings, boundaries: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """``file_id, path, length, destination, resolved`` of the valid files of a library.

    Files delivered more than once count once. With duplicate handling ``skip`` only the first path of a
    checksum is planned. Destinations outside the template's root fail the query.
    """
    needed = ("path", "dir", "name", "stem", "length", "location", "checksum", *ENRICHED_FROM)
    rows = destinations(library(files, *needed), settings, boundaries).where("is_valid")
    if settings.duplicate_handling == "skip":
        first = first_of_checksum(rows).withColumnRenamed("checksum", "_sum")
        rows = rows.join(first, F.lower(F.trim("checksum")) == F.col("_sum"), "left").where(F.col("first_path").isNull() | (F.col("first_path") == F.col("path")))
    rows = rows.select("file_id", "path", "length", "destination")
    rows = filters.assert_safe(rows, "destination", filters.destination_root(settings.destination))
    return collisions.resolve_collisions(rows, existing, "path", "destination", settings.duplicates_format, settings.existing)


def with_related(planned: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """The plan with ``owner_id``: related files go beside the resolved path of the first main file by path.

    A file that is related to one with an earlier path is no operation of its own.
    """
    lib = library(files, "path", "dir", "name", "stem")
    pairs = related_files(lib, mode)
    names = lib.select("file_id", "path", "name")
    m = names.select(F.col("file_id").alias("main_id"), F.col("path").alias("main_path"), F.col("name").alias("main_name"))
    r = names.select(F.col("file_id").alias("related_id"), F.col("path").alias("related_path"), F.col("name").alias("related_name"))
    owned = pairs.join(m, "main_id").join(r, "related_id").where("main_path < related_path")
    owner = owned.groupBy("related_id").agg(F.min(F.struct("main_path", "main_id", "main_name", "related_name")).alias("o"))
    # An owner that is itself related passes its own owner's place on only one step; roots are those without owner.
    roots = planned.join(owner.select(F.col("related_id").alias("file_id")), "file_id", "left_anti").withColumn("owner_id", F.lit(None).cast("bigint"))
    sources = planned.select(F.col("file_id").alias("main_id"), F.col("resolved").alias("main_resolved"))
    follow = owner.select("related_id", "o.*").join(sources, "main_id").join(planned.withColumnRenamed("file_id", "related_id").drop("resolved"), "related_id")
    moved = follow.select(F.col("related_id").alias("file_id"), "path", "length", "destination", related_destination(F.col("main_name"), F.col("main_resolved"), F.col("related_name")).alias("resolved"), F.col("main_id").alias("owner_id"))
    return roots.unionByName(moved)


def plan_totals(planned: DataFrame) -> DataFrame:
    """One row: operations, distinct folders (without case), bytes."""
    return planned.agg(F.count("resolved").alias("operations"), F.count_distinct(F.lower(dir_name(F.col("resolved")))).alias("folders"), F.coalesce(F.sum(F.when(F.col("resolved").isNotNull(), F.col("length"))), F.lit(0)).cast("bigint").alias("total_bytes"))


def plan_folders(planned: DataFrame) -> DataFrame:
    """``folder``: the distinct folders of a plan, without case."""
    return planned.where("resolved is not null").groupBy(F.lower(dir_name(F.col("resolved"))).alias("_k")).agg(F.min(dir_name(F.col("resolved"))).alias("folder")).select("folder")
