"""Destination templates: parsed once on the driver, evaluated as one Column.

    template := (text | '{' link ('|' link)* '}')*
    link     := name ['?' condition ((',' | '?') condition)*]     condition := ('min' | 'max') '=' number

A link whose name is no variable is a literal; the empty literal leaves the segment out. The first link
whose value is not empty and whose conditions hold wins. Where none does, the text is the global fallback.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.config import GRANULARITIES, VARIABLES, Settings
from framelake.functions.text import apply_casing, sanitize_segment
from framelake.operators.lookup import lookup_join

LOCATION = ("district", "city", "county", "state", "country")
CHAINED = (*LOCATION, "camera", "album")
_LINK = re.compile(r"([A-Za-z]+)((?:[?,](?:min|max)=\d+)*)", re.I)


@dataclass(frozen=True)
class Link:
    name: str
    least: int | None = None
    most: int | None = None
    literal: str | None = None
    unknown: bool = False


@dataclass(frozen=True)
class Variable:
    links: tuple[Link, ...]


def _link(text: str, first: bool) -> Link:
    m = _LINK.fullmatch(text)
    if m and m[1].lower() in VARIABLES:
        bounds = {k.lower(): int(n) for k, n in re.findall(r"(min|max)=(\d+)", m[2], re.I)}
        return Link(m[1].lower(), bounds.get("min"), bounds.get("max"))
    return Link(text.split("?")[0].lower() if first else "", literal=text, unknown=first)


def parse_template(template: str) -> list[str | Variable]:
    """Texts and variables of a template in order."""
    parts: list[str | Variable] = []
    for i, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if i % 2:
            parts.append(Variable(tuple(_link(x, n == 0) for n, x in enumerate(piece.split("|")))))
        elif piece:
            parts.append(piece)
    return parts


def counted_levels(template: str) -> list[str]:
    """The location variables whose counts a template needs."""
    return [v for v in LOCATION if any(link.name == v and (link.least is not None or link.most is not None) for p in parse_template(template) if isinstance(p, Variable) for link in p.links)]


def location_values(location: Column, settings: Settings, country_name: Column | None = None) -> dict[str, Column]:
    """The raw value of each location variable at the configured granularity; null where masked or missing."""
    level = GRANULARITIES.index(settings.granularity)
    none = F.lit(None).cast("string")
    return {
        "district": location["district"] if level == 0 else none,
        "city": F.coalesce(location["city"], location["district"]) if level == 0 else none,
        "county": location["county"] if level <= 1 else none,
        "state": location["state"] if level <= 2 else none,
        "country": country_name if settings.full_country_names and country_name is not None else location["country"],
    }


def with_counts(files: DataFrame, levels: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds ``_n_<level>``: over all files, how many share the row's value, without case; blank values have none.

    The counts are aggregated first and joined back, so a value that holds a third of the rows is one row
    in a small table and no window has to hold its group.
    """
    for level in levels:
        key = f"_key_{level}"
        keyed = files.withColumn(key, F.lower(values[level]))
        counts = keyed.where(F.trim(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias(f"_n_{level}"))
        files = lookup_join(keyed, counts, [key]).drop(key)
    return files


def _directory(relative_dir: Column) -> Column:
    kept = F.filter(F.split(relative_dir, r"[/\\]+"), lambda s: ~s.isin("", ".", ".."))
    return F.array_join(F.filter(F.transform(kept, lambda s: sanitize_segment(s)), lambda s: s != ""), "/")


def plain_values(ts: Column, name: Column, stem: Column, ext: Column, relative_dir: Column) -> dict[str, Column]:
    """Variables that take no conditions: dates, names and the source folder."""
    return {
        "year": F.date_format(ts, "yyyy"),
        "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"),
        "dayofyear": F.lpad(F.dayofyear(ts).cast("string"), 3, "0"),
        "name": stem,
        "namenoext": stem,
        "ext": ext,
        "filename": name,
        "directory": _directory(relative_dir),
        "number": F.lit(""),
    }


def normalise_path(path: Column) -> Column:
    """Without repeated separators, segments of only ``-`` and ``_``, and such signs at a segment's start."""
    path = F.regexp_replace(path, r"[\\/]{2,}", "/")
    path = F.regexp_replace(path, r"[\\/][-_]+[\\/]", "/")
    return F.regexp_replace(path, r"(?<=[\\/])[-_]+(?=[^-_\\/])", "")


def evaluate(template: str, plain: dict[str, Column], chained: dict[str, Column], settings: Settings, counts: dict[str, Column] | None = None) -> Column:
    """The destination path of a row; ``counts`` has the column of each level that conditions name."""
    counts = counts or {}
    pieces = []
    for part in parse_template(template):
        if isinstance(part, str):
            pieces.append(F.lit(part))
            continue
        head = part.links[0].name
        if head in plain:
            pieces.append(F.coalesce(plain[head], F.lit("")))
            continue
        fallback = {"camera": settings.unknown_camera, "album": settings.unknown_album}.get(head)
        choices = []
        for link in part.links:
            if link.literal is not None and not link.unknown:
                choices.append(apply_casing(F.lit(link.literal), settings.casing))
                break
            value = chained.get(link.name)
            if value is None:
                continue
            shown = sanitize_segment(apply_casing(value, settings.casing))
            n = F.coalesce(counts.get(link.name, F.lit(0)), F.lit(0))
            holds = shown != ""
            if link.least is not None:
                holds = holds & (n >= link.least)
            if link.most is not None:
                holds = holds & (n <= link.most)
            choices.append(F.when(holds, shown))
        pieces.append(F.coalesce(*choices, F.lit(settings.unknown if fallback is None else fallback)))
    return normalise_path(F.concat(*pieces)) if pieces else F.lit("")
