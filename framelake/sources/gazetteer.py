"""Gazetteer dumps, code tables and border files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.record_parser import FIELDS


def read_places(spark: SparkSession, path: str, classes: tuple[str, ...] = ("P", "A")) -> DataFrame:
    """Places of a tab-separated dump without quoting: at least 15 columns, of the given classes, with coordinates."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).withColumn("f", parts).where(F.size("f") >= 15)
    at = {n: F.get("f", F.lit(i)) for i, n in enumerate(FIELDS)}
    typed = rows.select(
        at["geonameid"].try_cast("bigint").alias("place_id"), at["name"].alias("name"), at["latitude"].try_cast("double").alias("lat"), at["longitude"].try_cast("double").alias("lon"),
        at["feature_class"].alias("feature_class"), at["feature_code"].alias("feature_code"), at["country"].alias("country"), at["admin1"].alias("admin1"),
        F.coalesce(at["population"].try_cast("bigint"), F.lit(0)).alias("population"),
    )
    return typed.where(F.col("feature_class").isin(*classes) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def read_admin1(spark: SparkSession, path: str) -> DataFrame:
    """``country, admin1, name`` of lines ``CC.CODE<TAB>name``; ``#`` starts a comment."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains("\t")).withColumn("f", parts)
    code = F.get("f", F.lit(0))
    return rows.where(code.contains(".")).select(F.substring_index(code, ".", 1).alias("country"), F.regexp_replace(code, r"^[^.]*\.", "").alias("admin1"), F.get("f", F.lit(1)).alias("name"))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """``code, country_name``: the first and the fifth column; ``#`` starts a comment."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("f", parts).where(F.size("f") >= 5)
    return rows.select(F.get("f", F.lit(0)).alias("code"), F.get("f", F.lit(4)).alias("country_name"))


_GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_borders(spark: SparkSession, path: str) -> DataFrame:
    """``country, name, polygon_id, ring, holes`` of a GeoJSON file of Polygon and MultiPolygon features.

    The code is ISO_A2, else ISO_A2_EH, else the first two letters of ADM0_A3; ``-99`` is no code. The first
    ring is the outside, the others are holes; rings of fewer than 3 points are dropped.
    """
    rows = spark.read.schema(_GEOJSON).option("multiLine", "true").json(path).select(F.posexplode("features").alias("no", "f"))
    props = F.col("f.properties")
    code = F.coalesce(*[F.nullif(props[k], F.lit("-99")) for k in ("ISO_A2", "ISO_A2_EH")], F.left(props["ADM0_A3"], F.lit(2)))
    ring_type = "array<array<array<double>>>"
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{ring_type}>")).when(
        F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", ring_type))
    )
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    polygons = rows.select(code.alias("country"), F.coalesce(props["NAME"], props["ADMIN"]).alias("name"), "no", F.posexplode(many).alias("part", "rings"))
    good = polygons.where(F.size(F.get("rings", F.lit(0))) >= 3)
    holes = F.filter(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: F.size(r) >= 3)
    return good.select("country", "name", (F.col("no") * 10_000 + F.col("part")).cast("int").alias("polygon_id"), points(F.get("rings", F.lit(0))).alias("ring"), F.transform(holes, points).alias("holes"))
