"""Sidecar texts: exported photo JSON and XMP."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from framelake.functions.coordinates import xmp_altitude, xmp_coordinate
from framelake.functions.times import sidecar_date

# Fixed values.
NO_FIX = 1e-4
RDF, XMP, EXIF, PHOTOSHOP, DC, XML = (
    "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://ns.adobe.com/xap/1.0/}", "{http://ns.adobe.com/exif/1.0/}",
    "{http://ns.adobe.com/photoshop/1.0/}", "{http://purl.org/dc/elements/1.1/}", "{http://www.w3.org/XML/1998/namespace}",
)


def photo_json(text: Column) -> Column:
    """``struct(taken, lat, lon, altitude, title, description)`` of an export; null without date, position and title.

    Numbers may be written as strings. The photo's time outranks the creation time, geoData outranks
    geoDataExif; a position with both sides under 0.0001 degrees is none.
    """
    get = lambda path: F.get_json_object(text, path)
    seconds = F.coalesce(get("$.photoTakenTime.timestamp").try_cast("bigint"), get("$.creationTime.timestamp").try_cast("bigint"))

    def position(name: str) -> Column:
        lat, lon = get(f"$.{name}.latitude").try_cast("double"), get(f"$.{name}.longitude").try_cast("double")
        real = lat.isNotNull() & lon.isNotNull() & ~((F.abs(lat) < NO_FIX) & (F.abs(lon) < NO_FIX))
        return F.when(real, F.struct(lat.alias("lat"), lon.alias("lon"), get(f"$.{name}.altitude").try_cast("double").alias("altitude")))

    at = F.coalesce(position("geoData"), position("geoDataExif"))
    title = F.when(get("$.title") != "", get("$.title"))
    row = F.struct(F.timestamp_seconds(seconds).alias("taken"), at["lat"].alias("lat"), at["lon"].alias("lon"), at["altitude"].alias("altitude"), title.alias("title"), get("$.description").alias("description"))
    return F.when(seconds.isNotNull() | at.isNotNull() | title.isNotNull(), row)


def _first(nodes: list[ET.Element], names: list[str]) -> str | None:
    """Of the names in order the first value of any description, an attribute before an element."""
    for name in names:
        for node in nodes:
            value = node.get(name)
            if value is None:
                child = node.find(name)
                value = _alternative(child) if child is not None else None
            if value and value.strip():
                return value.strip()
    return None


def _alternative(node: ET.Element) -> str | None:
    items = node.findall(f"{RDF}Alt/{RDF}li")
    chosen = next((i for i in items if i.get(f"{XML}lang") == "x-default"), items[0] if items else node)
    return chosen.text


def xmp_fields(text: str | None) -> dict[str, str | None]:
    """The raw values of an XMP text; all None where it is no XML."""
    names = ("date", "lat", "lon", "altitude", "title", "description")
    try:
        nodes = list(ET.fromstring(text).iter(f"{RDF}Description")) if text else []
    except ET.ParseError:
        nodes = []
    wanted = ([f"{XMP}CreateDate", f"{PHOTOSHOP}DateCreated", f"{EXIF}DateTimeOriginal"], [f"{EXIF}GPSLatitude"], [f"{EXIF}GPSLongitude"], [f"{EXIF}GPSAltitude"], [f"{DC}title"], [f"{DC}description"])
    return {n: _first(nodes, w) for n, w in zip(names, wanted, strict=True)}


def packet_value(text: str, names: tuple[str, ...]) -> str | None:
    """The first of some properties, by their full names, that an XMP text has a value of."""
    try:
        return _first(list(ET.fromstring(text).iter(f"{RDF}Description")), list(names))
    except ET.ParseError:
        return None


_XMP = StructType([StructField(n, StringType()) for n in ("date", "lat", "lon", "altitude", "title", "description")])


@F.pandas_udf(_XMP)
def _xmp_raw(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([xmp_fields(t) for t in text], columns=_XMP.names)


def xmp(text: Column) -> Column:
    """``struct(taken, lat, lon, altitude, title, description)``; a lone latitude or longitude voids the position."""
    raw = _xmp_raw(text)
    lat, lon = xmp_coordinate(raw["lat"], False), xmp_coordinate(raw["lon"], True)
    both = lat.isNotNull() & lon.isNotNull()
    return F.struct(
        sidecar_date(raw["date"]).alias("taken"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"),
        xmp_altitude(raw["altitude"]).alias("altitude"), raw["title"].alias("title"), raw["description"].alias("description"),
    )
