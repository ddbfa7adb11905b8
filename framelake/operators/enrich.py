"""Row-wise enrichment: timestamp, sidecar, coordinates, clock and zone, camera and album.

Steps run in that order, so that a zone by position sees the coordinates a sidecar brought, and the clock
correction also moves a sidecar's date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.config import Settings
from framelake.functions.text import sanitize_segment
from framelake.functions.times import chosen_timestamp, in_zone, shifted


#: What :func:`enriched` reads.
ENRICHED_FROM = ("ext", "created", "modified", "taken", "lat", "lon", "make", "model", "album_xmp", "album_iptc", "album_xp", "description")


def library(files: DataFrame, *columns: str) -> DataFrame:
    """Each file once, by its latest delivery; rows without file_id are left out.

    Only ``columns`` (all where none are named) are read and shuffled: the optimiser cannot prune the fields
    of the struct that the deliveries are compared by.
    """
    rest = list(columns) or [c for c in files.columns if c != "file_id"]
    one = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct(F.col("seen_at").alias("_order"), *rest)).alias("_row"))
    return one.select("file_id", *[F.col("_row").getField(c).alias(c) for c in rest])


def has_coordinates(lat: Column, lon: Column) -> Column:
    """Both present, in range, and not the (0, 0) of a missing fix."""
    return lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def camera_name(make: Column, model: Column) -> Column:
    """Make and model, the make left out where the model starts with it; a usable name, or null."""
    make, model = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    both = F.when(model == "", make).when(make == "", model).when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.concat(make, F.lit(" "), model))
    clean = F.trim(F.regexp_replace(sanitize_segment(both), r"\s+", " "))
    return F.when(clean != "", clean)


def album_name(xmp: Column, iptc: Column, xp: Column, description: Column) -> Column:
    """The first that isn't blank of XMP, IPTC, XP subject, and the rest of a description after ``Album:``."""
    said = F.when(F.lower(description).startswith("album:"), F.trim(F.substring(description, 7, 1 << 30)))
    picked = F.coalesce(*[F.when(F.trim(c) != "", c) for c in (xmp, iptc, xp, said)])
    clean = F.trim(F.regexp_replace(sanitize_segment(picked), r"\s+", " "))
    return F.when(clean != "", clean)


def merge_sidecar(files: DataFrame, priority: str = "embedded_first") -> DataFrame:
    """``taken``, ``lat``, ``lon`` from the embedded values and the columns ``side_taken, side_lat, side_lon``."""
    if priority not in ("embedded_first", "sidecar_first"):
        raise ValueError(f"unknown priority {priority!r}")
    own, side = has_coordinates(F.col("lat"), F.col("lon")), has_coordinates(F.col("side_lat"), F.col("side_lon"))
    use_side = side & ~own if priority == "embedded_first" else side
    first, second = ("taken", "side_taken") if priority == "embedded_first" else ("side_taken", "taken")
    return files.withColumns({"taken": F.coalesce(first, second), "lat": F.when(use_side, F.col("side_lat")).otherwise(F.col("lat")), "lon": F.when(use_side, F.col("side_lon")).otherwise(F.col("lon"))})


def enriched(files: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``ts, ts_source, camera, album, supported`` by the settings; null coordinates where unusable."""
    usable = has_coordinates(F.col("lat"), F.col("lon"))
    picked = chosen_timestamp(F.col("taken"), F.col("created"), F.col("modified"))
    base = files.withColumns({"_picked": picked, "lat": F.when(usable, F.col("lat")), "lon": F.when(usable, F.col("lon"))})
    ts = in_zone(shifted(F.col("_picked.ts"), settings.time_offset), settings.zone_mode, settings.zone, F.col("lon"))
    return base.withColumns(
        {
            "ts": ts,
            "ts_source": F.col("_picked.source"),
            "camera": camera_name(F.col("make"), F.col("model")),
            "album": album_name(F.col("album_xmp"), F.col("album_iptc"), F.col("album_xp"), F.col("description")),
            "supported": F.coalesce(F.lower("ext").isin(*settings.allowed_extensions), F.lit(False)),
        }
    ).drop("_picked")


def location_reason(lat: Column, lon: Column, location: Column, failed: Column) -> Column:
    """Why a row has no location: extraction error, no coordinates, geocoding without result, or None."""
    return F.when(failed, "GpsExtractionError").when(lat.isNull() | lon.isNull(), "NoGpsData").when(location.isNull(), "GeocodingFailed").otherwise("None")
