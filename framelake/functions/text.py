"""Casing, path-segment and number formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CASINGS = ("original", "lower", "upper", "title", "pascal", "camel", "snake", "kebab", "screaming_snake")
RESERVED_NAMES = (
    "CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
INVALID_CHARS = r'[\x00-\x1F<>:"/\\|?*]'
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
UNKNOWN_REASONS = {
    "NoGpsData": ("No GPS data in file metadata", "NO-GPS"),
    "GpsExtractionError": ("Error extracting GPS data", "GPS-ERR"),
    "GeocodingFailed": ("Geocoding failed to find location", "GEO-FAIL"),
}


def split_words(text: Column) -> Column:
    """Words of a text: separated by space, ``_``, ``-``, ``.``, and before a capital followed by a small letter."""
    spaced = F.translate(text, "_-.", "   ")
    return F.filter(F.split(F.regexp_replace(spaced, r"(?<!^)(?<![\s_\-])([A-Z][a-z])", " $1"), " "), lambda w: w != "")


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def apply_casing(text: Column, casing: str) -> Column:
    """A text in one of CASINGS; null stays null, the empty text empty."""
    if casing not in CASINGS:
        raise ValueError(f"unknown casing {casing!r}; known: {', '.join(CASINGS)}")
    words = split_words(text)
    if casing == "original":
        return text
    if casing == "lower":
        return F.lower(text)
    if casing == "upper":
        return F.upper(text)
    if casing == "title":
        return F.array_join(F.transform(words, _capitalised), " ")
    if casing == "pascal":
        return F.array_join(F.transform(words, _capitalised), "")
    if casing == "camel":
        return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capitalised(w))), "")
    joined = F.array_join(words, "-" if casing == "kebab" else "_")
    return F.upper(joined) if casing == "screaming_snake" else F.lower(joined)


def sanitize_segment(text: Column, replacement: str = "_") -> Column:
    """A text usable as a folder or file name; null and blank become empty.

    Invalid characters are replaced, outer white space and trailing dots dropped; a reserved device name,
    with or without extension, gets a trailing ``_``.
    """
    clean = F.regexp_replace(F.regexp_replace(text, INVALID_CHARS, replacement), r"^\s+|\s+$", "")
    clean = F.regexp_replace(clean, r"\.+$", "")
    reserved = F.upper(F.substring_index(clean, ".", 1)).isin(*RESERVED_NAMES)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").when(reserved, F.concat(clean, F.lit("_"))).otherwise(clean)


def sanitize_or(text: Column, fallback: Column) -> Column:
    clean = sanitize_segment(text)
    return F.when(clean != "", clean).otherwise(fallback)


def has_invalid_chars(text: Column) -> Column:
    return F.coalesce(text.rlike(INVALID_CHARS), F.lit(False))


def file_stem(name: Column) -> Column:
    """A name up to its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_extension(name: Column) -> Column:
    """The last dot and what follows; empty without one."""
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def _ladder(size: Column, units: tuple[str, ...]) -> tuple[Column, Column]:
    """(value in the largest unit it reaches, the unit's name)."""
    value, unit = size.cast("double"), F.lit(units[0])
    for i in range(1, len(units)):
        reached = size >= F.lit(1024**i)
        value = F.when(reached, size / F.lit(float(1024**i))).otherwise(value)
        unit = F.when(reached, units[i]).otherwise(unit)
    return value, unit


def format_bytes(size: Column) -> Column:
    """At most two decimals and no trailing zeros, up to TB; the sign before."""
    value, unit = _ladder(F.abs(size), BYTE_UNITS[:5])
    digits = F.regexp_replace(F.round(value, 2).cast("decimal(30,2)").cast("string"), r"\.?0+$", "")
    whole = F.round(value, 2).cast("decimal(30,2)").cast("string")
    digits = F.when(whole.endswith(".00"), F.substring_index(whole, ".", 1)).otherwise(digits)
    return F.when(size == 0, "0 B").otherwise(F.concat(F.when(size < 0, "-").otherwise(""), digits, F.lit(" "), unit))


def format_bytes_report(size: Column) -> Column:
    """One decimal and thousands separators, up to PB; bytes whole, negative sizes as ``0 B``."""
    value, unit = _ladder(size, BYTE_UNITS)
    shown = F.when(size < 1024, F.format_number(value, 0)).otherwise(F.format_number(value, 1))
    return F.when(size < 0, "0 B").otherwise(F.concat(shown, F.lit(" "), unit))


def truncate_name(name: Column, most: int = 30) -> Column:
    """A name cut to ``most`` characters from the left, marked by ``...``."""
    return F.when(F.length(name) > most, F.concat(F.lit("..."), F.right(name, F.lit(most - 3)))).otherwise(name)


def format_duration(seconds: Column) -> Column:
    """``1h 02m``, ``3m 04s`` or ``5s``."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.floor(F.pmod(seconds, F.lit(60)))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(seconds >= 3600, F.concat(h.cast("string"), F.lit("h "), pad(m), F.lit("m")))
        .when(seconds >= 60, F.concat(m.cast("string"), F.lit("m "), pad(s), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def percentage(part: Column, whole: Column) -> Column:
    """One decimal; 0 of an empty whole."""
    return F.round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), 1)


def reason_text(reason: Column) -> Column:
    return F.coalesce(*[F.when(reason == k, v[0]) for k, v in UNKNOWN_REASONS.items()], F.lit("Unknown"))


def reason_code(reason: Column) -> Column:
    return F.coalesce(*[F.when(reason == k, v[1]) for k, v in UNKNOWN_REASONS.items()], F.lit("UNKNOWN"))


def trim_separators(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]+$", "")
