"""What image and video contents tell of themselves.

EXIF blocks (in JPEG, TIFF, PNG and HEIC), IPTC records (in JPEG), XMP packets (in JPEG, TIFF, PNG and HEIC), and the
times and positions of QuickTime and MP4 movies.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from framelake.sources.sidecars import packet_value, xmp_fields

META = StructType(
    [
        StructField("taken", TimestampType()),
        *[StructField(n, DoubleType()) for n in ("lat", "lon")],
        *[StructField(n, StringType()) for n in ("make", "model", "description", "album_xmp", "album_iptc", "album_xp")],
    ]
)

# Tag numbers and type sizes of the EXIF standard.
MAKE, MODEL, DESCRIPTION, EXIF_IFD, GPS_IFD = 0x010F, 0x0110, 0x010E, 0x8769, 0x8825
ORIGINAL, DIGITIZED, PLAIN_DATE = 0x9003, 0x9004, 0x0132
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
XP_SUBJECT, XMP_PACKET = 0x9C9F, 0x02BC
#: Markers of the container formats, and the records of IPTC.
JPEG_XMP, JPEG_EXIF, JPEG_IPTC = b"http://ns.adobe.com/xap/1.0/\x00", b"Exif\x00\x00", b"Photoshop 3.0\x00"
PNG, PNG_XMP = b"\x89PNG\r\n\x1a\n", b"XML:com.adobe.xmp\x00"
STILL_BRANDS = (b"heic", b"heix", b"heif", b"mif1", b"msf1", b"avif")
IPTC_RESOURCE, IPTC_CATEGORY, IPTC_CAPTION = 0x0404, 20, 120
ALBUM_NAMES = ("{http://ns.adobe.com/xap/1.0/}Album", "{http://ns.adobe.com/photoshop/1.0/}Album", "{http://purl.org/dc/elements/1.1/}album")
MOVIE_EPOCH = datetime(1904, 1, 1)
LOCATION_KEY, DATE_KEY = b"com.apple.quicktime.location.ISO6709", b"com.apple.quicktime.creationdate"

TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

_PACKET_DEGREES = re.compile(r"(-?\d+(?:\.\d+)?)(?:,(\d+(?:\.\d+)?))?(?:,(\d+(?:\.\d+)?))?([NSEWnsew])?")
_POSITION = re.compile(rb"([+-]\d+\.?\d*)([+-]\d+\.?\d*)(?:[+-]\d+\.?\d*)?/")


@dataclass
class _Parts:
    """The blocks of a file that hold metadata."""

    tiff: bytes | None = None
    xmp: bytes | None = None
    iptc: bytes | None = None


def _jpeg_parts(data: bytes) -> _Parts:
    out, at = _Parts(), 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body.startswith(JPEG_EXIF) and out.tiff is None:
            out.tiff = body[len(JPEG_EXIF) :]
        elif data[at + 1] == 0xE1 and body.startswith(JPEG_XMP) and out.xmp is None:
            out.xmp = body[len(JPEG_XMP) :]
        elif data[at + 1] == 0xED and body.startswith(JPEG_IPTC):
            out.iptc = (out.iptc or b"") + body[len(JPEG_IPTC) :]
        at += 2 + max(size, 2)
    return out


def _png_parts(data: bytes) -> _Parts:
    out, at = _Parts(), len(PNG)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"eXIf":
            out.tiff = body
        elif kind == b"iTXt" and body.startswith(PNG_XMP) and body[len(PNG_XMP) : len(PNG_XMP) + 1] == b"\x00":
            out.xmp = body[len(PNG_XMP) + 2 :].split(b"\x00", 2)[-1]  # behind language and translated keyword
        elif kind == b"IEND":
            break
        at += 12 + size
    return out


def _boxes(data: bytes, start: int, end: int):
    """(kind, start, end) of the boxes of an ISO media file within a span."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        stop = end if size == 0 else start + size
        if stop > end or stop < start + head:
            return
        yield kind, start + head, stop
        start = stop


def _box(data: bytes, path: tuple[bytes, ...], start: int, end: int) -> tuple[int, int] | None:
    """The span of the first box at a path of kinds; a ``meta`` box of the full form has four bytes before its boxes."""
    for kind in path:
        found = next(((s, e) for k, s, e in _boxes(data, start, end) if k == kind), None)
        if found is None:
            return None
        start, end = found
        if kind == b"meta" and data[start : start + 4] == b"\x00\x00\x00\x00":
            start += 4
    return start, end


def _number(data: bytes, at: int, size: int) -> tuple[int, int]:
    return int.from_bytes(data[at : at + size], "big"), at + size


def _item_kinds(data: bytes, start: int, end: int) -> dict[int, bytes]:
    """Of the items of a still image their kinds: ``Exif``, or ``mime`` with the content type."""
    version = data[start]
    at = start + 4 + (2 if version == 0 else 4)
    kinds = {}
    for kind, s, _ in _boxes(data, at, end):
        if kind == b"infe" and data[s] in (2, 3):
            item, at = _number(data, s + 4, 2 if data[s] == 2 else 4)
            kinds[item] = data[at + 2 : at + 6]
    return kinds


def _item_places(data: bytes, start: int, end: int) -> dict[int, list[tuple[int, int]]]:
    """Of the items of a still image where in the file their bytes lie."""
    version = data[start]
    sizes, at = _number(data, start + 4, 2)
    of_offset, of_length, of_base, of_index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    count, at = _number(data, at, 4 if version == 2 else 2)
    places = {}
    for _ in range(count):
        if at >= end:
            break
        item, at = _number(data, at, 4 if version == 2 else 2)
        method, at = _number(data, at, 2) if version else (0, at)
        base, at = _number(data, at + 2, of_base)
        extents, at = _number(data, at, 2)
        own = []
        for _ in range(extents):
            _, at = _number(data, at, of_index)
            offset, at = _number(data, at, of_offset)
            length, at = _number(data, at, of_length)
            own.append((base + offset, length))
        if method & 15 == 0:  # of the file itself
            places[item] = own
    return places


def _still_parts(data: bytes) -> _Parts:
    out = _Parts()
    kinds, places = _box(data, (b"meta", b"iinf"), 0, len(data)), _box(data, (b"meta", b"iloc"), 0, len(data))
    if kinds and places:
        where = _item_places(data, *places)
        for item, kind in _item_kinds(data, *kinds).items():
            body = b"".join(data[at : at + size] for at, size in where.get(item, ()))
            if kind == b"Exif" and len(body) > 4:
                out.tiff = body[4 + struct.unpack_from(">I", body)[0] :]
            elif kind == b"mime" and b"<x:xmpmeta" in body or b"<rdf:RDF" in body:
                out.xmp = body
    return out


def _parts(data: bytes) -> _Parts:
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        return _Parts(tiff=data)
    if data[:2] == b"\xff\xd8":
        return _jpeg_parts(data)
    if data.startswith(PNG):
        return _png_parts(data)
    if data[4:8] == b"ftyp" and data[8:12] in STILL_BRANDS:
        return _still_parts(data)
    return _Parts()


def _iptc_values(block: bytes) -> dict[int, list[str]]:
    """Values of the application record by number, of the resources of an image editor."""
    out: dict[int, list[str]] = {}
    at = 0
    while at + 12 <= len(block) and block[at : at + 4] == b"8BIM":
        (resource,) = struct.unpack_from(">H", block, at + 4)
        name = 1 + block[at + 6]
        at += 6 + name + name % 2
        (size,) = struct.unpack_from(">I", block, at)
        body, at = block[at + 4 : at + 4 + size], at + 4 + size + size % 2
        place = 0
        while resource == IPTC_RESOURCE and place + 5 <= len(body) and body[place] == 0x1C:
            record, number, length = struct.unpack_from(">BBH", body, place + 1)
            if length & 0x8000:
                break
            if record == 2:
                out.setdefault(number, []).append(body[place + 5 : place + 5 + length].decode("utf-8", "replace").strip())
            place += 5 + length
    return out


def _movie_values(data: bytes) -> dict[str, object]:
    """``taken, lat, lon`` of a movie: its keyed metadata first, then the header's time and the position record."""
    out: dict[str, object] = {}
    movie = _box(data, (b"moov",), 0, len(data))
    keyed: dict[bytes, bytes] = {}
    if movie:
        names, items = _box(data, (b"meta", b"keys"), *movie), _box(data, (b"meta", b"ilst"), *movie)
        if names and items:
            listed = [data[s:e] for _, s, e in _boxes(data, names[0] + 8, names[1])]
            for kind, s, e in _boxes(data, *items):
                number = int.from_bytes(kind, "big")
                held = next(((a, b) for k, a, b in _boxes(data, s, e) if k == b"data"), None)
                if held and 1 <= number <= len(listed):
                    keyed[listed[number - 1]] = data[held[0] + 8 : held[1]]
        header = _box(data, (b"mvhd",), *movie)
        if header:
            seconds, _ = _number(data, header[0] + 4, 8 if data[header[0]] == 1 else 4)
            if 0 < seconds < 1 << 33:
                out["taken"] = MOVIE_EPOCH + timedelta(seconds=seconds)
    if DATE_KEY in keyed:
        try:
            when = datetime.fromisoformat(keyed[DATE_KEY].decode("ascii", "replace").strip())
            out["taken"] = when.astimezone(UTC).replace(tzinfo=None) if when.tzinfo else when
        except ValueError:
            pass
    at = data.find(b"\xa9xyz")
    for text in (keyed.get(LOCATION_KEY), data[at : at + 64] if at >= 0 else None):
        m = _POSITION.search(text) if text else None
        if m and abs(lat := float(m[1])) <= 90 and abs(lon := float(m[2])) <= 180 and (lat or lon):
            return out | {"lat": lat, "lon": lon}
    return out


class _Tags:
    def __init__(self, block: bytes) -> None:
        self.block = block
        self.order = "<" if block[:2] == b"II" else ">"

    def read(self, offset: int) -> dict[int, object]:
        found: dict[int, object] = {}
        if not 0 < offset <= len(self.block) - 2:
            return found
        (n,) = struct.unpack_from(self.order + "H", self.block, offset)
        for i in range(n):
            at = offset + 2 + 12 * i
            if at + 12 > len(self.block):
                break
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.block, at)
            size = TYPE_SIZES.get(kind, 0) * count
            place = at + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.block, at + 8)[0]
            raw = self.block[place : place + size]
            if len(raw) == size and size:
                found[tag] = self.value(kind, count, raw)
        return found

    def value(self, kind: int, count: int, raw: bytes) -> object:
        if kind == 2:
            return raw.split(b"\x00")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            parts = struct.unpack(self.order + ("II" if kind == 5 else "ii") * count, raw)
            return [a / b if b else None for a, b in zip(parts[::2], parts[1::2], strict=True)]
        code = {3: "H", 4: "I", 9: "i"}.get(kind)
        return struct.unpack(self.order + code * count, raw)[0] if code else raw


def _date(text: object) -> datetime | None:
    try:
        return datetime.strptime(str(text), "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return None


def _degrees(parts: object, side: object) -> float | None:
    if not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    size = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -size if str(side).upper() in ("S", "W") else size


def _packet_date(text: str | None) -> datetime | None:
    """A packet's date as written; one with a zone in UTC."""
    try:
        when = datetime.fromisoformat(text.strip()) if text else None
    except ValueError:
        return None
    return when.astimezone(UTC).replace(tzinfo=None) if when and when.tzinfo else when


def _packet_degrees(text: str | None, sides: str) -> float | None:
    """Degrees of ``40,42.768N``, ``40,42,46.08N`` or a plain number."""
    m = _PACKET_DEGREES.fullmatch(text.strip()) if text else None
    if not m or (m[4] and m[4].upper() not in sides):
        return None
    size = float(m[1]) + float(m[2] or 0) / 60 + float(m[3] or 0) / 3600
    return -size if m[4] and m[4].upper() in "SW" else size


def read_metadata(data: bytes | None) -> dict[str, object]:
    """What a content tells of itself; missing and broken values are None. (0, 0) is no position.

    EXIF outranks XMP, which outranks IPTC; the album's three sources stay apart.
    """
    out: dict[str, object] = dict.fromkeys(META.names)
    if not data:
        return out
    if data[4:8] == b"ftyp" and data[8:12] not in STILL_BRANDS or data[4:8] == b"moov":
        return out | _movie_values(data)
    parts = _parts(data)
    packet = parts.xmp
    if parts.tiff is not None and len(parts.tiff) >= 8:
        tags = _Tags(parts.tiff)
        main = tags.read(struct.unpack_from(tags.order + "I", parts.tiff, 4)[0])
        exif = tags.read(main[EXIF_IFD]) if isinstance(main.get(EXIF_IFD), int) else {}
        gps = tags.read(main[GPS_IFD]) if isinstance(main.get(GPS_IFD), int) else {}
        out["taken"] = _date(exif.get(ORIGINAL)) or _date(exif.get(DIGITIZED)) or _date(main.get(PLAIN_DATE))
        lat, lon = _degrees(gps.get(LAT), gps.get(LAT_REF)), _degrees(gps.get(LON), gps.get(LON_REF))
        if lat is not None and lon is not None and (lat or lon) and abs(lat) <= 90 and abs(lon) <= 180:
            out["lat"], out["lon"] = lat, lon
        out |= {k: main.get(t) or None for k, t in (("make", MAKE), ("model", MODEL), ("description", DESCRIPTION))}
        if isinstance(main.get(XP_SUBJECT), bytes):
            out["album_xp"] = main[XP_SUBJECT].decode("utf-16-le", "replace").split("\x00")[0].strip() or None
        if packet is None and isinstance(main.get(XMP_PACKET), bytes):
            packet = main[XMP_PACKET]
    if packet is not None:
        text = packet.decode("utf-8", "replace").strip("\x00\ufeff \n\r\t")
        told = xmp_fields(text)
        out["taken"] = out["taken"] or _packet_date(told["date"])
        if out["lat"] is None:
            lat, lon = _packet_degrees(told["lat"], "NS"), _packet_degrees(told["lon"], "EW")
            if lat is not None and lon is not None and (lat or lon) and abs(lat) <= 90 and abs(lon) <= 180:
                out["lat"], out["lon"] = lat, lon
        out["description"] = out["description"] or told["description"]
        out["album_xmp"] = packet_value(text, ALBUM_NAMES)
    if parts.iptc is not None:
        values = _iptc_values(parts.iptc)
        out["album_iptc"] = next((v for v in values.get(IPTC_CATEGORY, []) if v), None)
        out["description"] = out["description"] or next((v for v in values.get(IPTC_CAPTION, []) if v), None)
    return out


@F.pandas_udf(META)
def media_metadata(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            rows.append(read_metadata(data))
        except (struct.error, IndexError, ValueError, OverflowError):
            rows.append(read_metadata(None))
    out = pd.DataFrame(rows, columns=META.names)
    return out.astype({"taken": "datetime64[us]", "lat": "float64", "lon": "float64"})
