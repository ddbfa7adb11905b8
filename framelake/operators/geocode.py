"""Nearest places by geohash cells, and the index of places those joins read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.geo import cell_hash, cell_x, cell_y, cells_within, feature_priority, haversine_km, neighbour_cells, place_type
from framelake.operators.enrich import has_coordinates
from framelake.operators.lookup import lookup_join
from framelake.session import ship_package

PRECISION = 4
RADIUS_KM = 50.0
TOWN = 2
PRUNE_KM = 5.0
PRUNE_CELLS = 8
PRIORITY_KM = 15.0


def place_index(places: DataFrame, precision: int = PRECISION, minimum_population: int = 0, classes: tuple[str, ...] = ("P",)) -> DataFrame:
    """Places with usable coordinates as ``place_id, name, country, admin1, population, lat, lon, kind, is_city, priority, x, y``."""
    usable = has_coordinates(F.col("lat"), F.col("lon")) & F.col("feature_class").isin(*classes)
    enough = F.coalesce("population", F.lit(0)) >= minimum_population
    kind = place_type(F.col("feature_code"), F.col("population"))
    return places.where(usable & enough).select(
        "place_id", "name", F.trim("country").alias("country"), "admin1", "population", F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"),
        kind.alias("kind"), (kind >= TOWN).alias("is_city"), feature_priority(F.col("feature_code")).alias("priority"),
        cell_x(F.col("lon"), precision).alias("x"), cell_y(F.col("lat"), precision).alias("y"),
    )


def _near(points: DataFrame, index: DataFrame, precision: int, ring: int | None, radius_km: float) -> DataFrame:
    """Each point joined with the places of its cell and those around, with ``km``.

    The points are first reduced to their distinct positions, so many files of one spot are one lookup; the
    places are bucketed into the cells around them, so a position meets its places by an equi-join. Without
    ``ring`` the cells are all that a circle of the radius about the place touches.
    """
    around = neighbour_cells(F.col("x"), F.col("y"), precision, ring) if ring is not None else cells_within(F.col("place_lat"), F.col("place_lon"), radius_km, precision)
    spread = index.withColumn("cell", F.explode(around)).drop("x", "y").select("*", "cell.x", "cell.y").drop("cell")
    at = points.withColumns({"x": cell_x(F.col("lon"), precision), "y": cell_y(F.col("lat"), precision)})
    joined = at.join(spread, ["x", "y"])
    return joined.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")))


def nearest_places(points: DataFrame, index: DataFrame, radius_km: float = RADIUS_KM, precision: int = PRECISION, ring: int | None = 1, by_country: bool = False) -> DataFrame:
    """``lat, lon, any_id, any_name, any_km, city_id, city_name, city_km, state, country``: one row a position.

    ``points`` has ``lat, lon`` (and ``country`` with ``by_country``, which then restricts the candidates
    where it is known). The nearest of all places and the nearest town or larger, strictly within the
    radius, in one aggregation; ties go to the smaller place_id. Distances are compared to the millimetre.
    State and country are those of the nearest place. Positions without a candidate give no row. With
    ``ring`` 1 at precision 4 places farther than about 20 km may lie beyond the cells searched; ``ring`` None
    searches the whole radius.
    """
    keys = ["lat", "lon", *(["point_country"] if by_country else [])]
    asked = points.where(has_coordinates(F.col("lat"), F.col("lon")))
    asked = asked.select("lat", "lon", *([F.col("country").alias("point_country")] if by_country else [])).distinct()
    near = _near(asked, index, precision, ring, radius_km).where(F.col("km") < radius_km)
    if by_country:
        near = near.where(F.col("point_country").isNull() | (F.col("point_country") == F.col("country")))
    best = F.struct(F.round("km", 6).alias("km"), "place_id", "name", "admin1", "country")
    got = near.groupBy(*keys).agg(F.min(best).alias("a"), F.min(F.when(F.col("is_city"), best)).alias("c"))
    return got.select(
        *keys, F.col("a.place_id").alias("any_id"), F.col("a.name").alias("any_name"), F.col("a.km").alias("any_km"),
        F.col("c.place_id").alias("city_id"), F.col("c.name").alias("city_name"), F.col("c.km").alias("city_km"), F.col("a.admin1").alias("state"), F.col("a.country").alias("country"),
    )


def reverse_geocode(points: DataFrame, index: DataFrame, radius_km: float = RADIUS_KM, countries: DataFrame | None = None, ring: int | None = 1) -> DataFrame:
    """``lat, lon, district, city, state, country`` of positions; no row where nothing is near.

    ``countries`` (``lat, lon, country``, at most one row a position) restricts a position's candidates to
    its country; where that leaves none, all candidates count.
    """
    pick = lambda df: df.select("lat", "lon", F.col("any_name").alias("district"), F.col("city_name").alias("city"), "state", "country")
    free = pick(nearest_places(points, index, radius_km, ring=ring))
    if countries is None:
        return free
    known = points.select("lat", "lon").distinct().join(countries.where("country is not null"), ["lat", "lon"])
    strict = pick(nearest_places(known, index, radius_km, ring=ring, by_country=True).drop("point_country"))
    both = free.alias("f").join(strict.alias("s"), ["lat", "lon"], "left")
    return both.select("lat", "lon", *[F.when(F.col("s.district").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("district", "city", "state", "country")])


def streamed_geocode(points: DataFrame, index: DataFrame, radius_km: float = RADIUS_KM, large_city: int = 100_000, ring: int | None = 1) -> DataFrame:
    """``lat, lon, any_id, city_id``: within 15 km the place of the highest priority, beyond it the nearest.

    A city is a place of at least ``large_city`` people; distances up to the radius, inclusive.
    """
    near = _near(points.where(has_coordinates(F.col("lat"), F.col("lon"))).select("lat", "lon").distinct(), index, PRECISION, ring, radius_km).where(F.col("km") <= radius_km)
    far = F.col("km") > PRIORITY_KM
    rank = F.struct(far.alias("far"), F.when(~far, -F.col("priority")).otherwise(0).alias("p"), F.round("km", 6).alias("km"), "place_id")
    got = near.groupBy("lat", "lon").agg(F.min(rank).alias("a"), F.min(F.when(F.col("population") >= large_city, rank)).alias("c"))
    return got.select("lat", "lon", F.col("a.place_id").alias("any_id"), F.col("c.place_id").alias("city_id"))


def admin_names(located: DataFrame, admin1_codes: DataFrame, country: str = "country", state: str = "state") -> DataFrame:
    """Replaces a state's code by its name where ``admin1_codes`` knows it."""
    names = admin1_codes.where("country is not null and admin1 is not null").groupBy("country", "admin1").agg(F.min("name").alias("_state"))
    names = names.select(F.col("country").alias(country), F.col("admin1").alias(state), "_state")
    return lookup_join(located, names, [country, state]).withColumn(state, F.coalesce("_state", state)).drop("_state")


def country_names(boundaries: DataFrame) -> DataFrame:
    """``code, country_name``: one name for each country code."""
    return boundaries.where("country is not null").groupBy(F.upper(F.trim("country")).alias("code")).agg(F.min("name").alias("country_name"))


def with_country_name(df: DataFrame, names: DataFrame, column: Column, into: str = "country_name") -> DataFrame:
    """Adds the full name of an ISO code; an unknown code stays as it is."""
    keyed = df.withColumn("_code", F.upper(F.trim(column)))
    dim = names.select(F.col("code").alias("_code"), F.col("country_name").alias("_full"))
    return lookup_join(keyed, dim, ["_code"]).withColumn(into, F.coalesce("_full", column)).drop("_code", "_full")


def prune_nearby(index: DataFrame, within_km: float = PRUNE_KM, precision: int = PRECISION) -> DataFrame:
    """The places kept of each cell: by kind, then population (then id), none within ``within_km`` of a kept one.

    Greedy within a cell; a cell of the default precision is about 20 by 39 km, which bounds how many places can be
    kept, and so the work for each. Neighbouring cells (PRUNE_CELLS by as many) are handed to a task together, as most
    hold few places.
    """

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.assign(_p=pdf["population"].fillna(0)).sort_values(["x", "y", "kind", "_p", "place_id"], ascending=[True, True, False, False, True], kind="stable").drop(columns="_p")
        lat, lon = np.radians(pdf["place_lat"].to_numpy()), np.radians(pdf["place_lon"].to_numpy())
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        ends = np.append(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, len(pdf))
        kept, low = [], 0
        for high in ends.tolist():
            la, lo, is_open = lat[low:high], lon[low:high], np.ones(high - low, dtype=bool)
            for i in range(high - low):
                if is_open[i]:
                    kept.append(low + i)
                    a = np.sin((la - la[i]) / 2) ** 2 + np.cos(la) * np.cos(la[i]) * np.sin((lo - lo[i]) / 2) ** 2
                    is_open &= 2 * 6371.0 * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0, 1 - a))) > within_km
            low = high
        return pdf.iloc[kept]

    ship_package(index.sparkSession)
    return index.groupBy(F.floor(F.col("x") / PRUNE_CELLS), F.floor(F.col("y") / PRUNE_CELLS)).applyInPandas(prune, index.schema)


def write_place_index(index: DataFrame, path: str, precision: int = PRECISION) -> None:
    """The index as parquet clustered by cell, so a reader's row groups hold few cells."""
    index.withColumn("cell", cell_hash(F.col("x"), F.col("y"), precision)).repartitionByRange("cell").sortWithinPartitions("cell", "kind").write.mode("overwrite").parquet(path)
