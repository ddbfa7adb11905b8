"""Settings of an organisation run: a frozen dataclass filled from layered sources, and its checks."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from framelake.functions.times import parse_offset

# Fixed values.
ALLOWED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".mov", ".mp4", ".avi", ".cr2", ".raf", ".nef", ".arw", ".dng")
VARIABLES = ("year", "month", "day", "dayofyear", "directory", "name", "namenoext", "ext", "filename", "district", "city", "county", "state", "country", "camera", "album", "number")
GRANULARITIES = ("city", "county", "state", "country")


@dataclass(frozen=True)
class Settings:
    source: str = ""
    destination: str = ""
    min_date: datetime | None = None
    max_date: datetime | None = None
    exclude: tuple[str, ...] = ()
    max_depth: int | None = None
    allowed_extensions: tuple[str, ...] = ALLOWED_EXTENSIONS
    granularity: str = "city"
    full_country_names: bool = False
    casing: str = "original"
    unknown: str = "Unknown"
    unknown_camera: str | None = None
    unknown_album: str | None = None
    duplicates_format: str = "-{number}"
    existing: str = "number"  # number, skip or overwrite
    related: str = "none"  # none, strict or loose
    duplicate_handling: str = "none"  # none, skip or report
    time_offset: timedelta | None = None
    zone_mode: str = "original"
    zone: str = "UTC"
    companion_minutes: int | None = None
    minimum_population: int = 0
    sidecar_priority: str = "embedded_first"  # or sidecar_first
    sidecar_extensions: tuple[str, ...] = (".xmp", ".json")
    dry_run: bool = True


@dataclass(frozen=True)
class Setting:
    """Where a setting's value came from."""

    name: str
    value: object
    source: str


@dataclass
class Diagnosis:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)


def _coerced(name: str, value: object) -> object:
    kind = {f.name: f.type for f in dataclasses.fields(Settings)}[name]
    if value is None or not isinstance(value, str | list):
        return value
    if "tuple" in kind:
        return tuple(value if isinstance(value, list) else [v.strip() for v in value.split(";") if v.strip()])
    if "datetime" in kind:
        return datetime.fromisoformat(value)
    if "timedelta" in kind:
        return parse_offset(value)
    if "bool" in kind:
        return value.strip().lower() in ("1", "true", "yes", "on")
    return int(value) if "int" in kind else value


def _parsed(file: str, text: str) -> Mapping[str, object]:
    """The settings of a file by its extension; YAML needs the yaml package."""
    if file.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{file}: no YAML reader is installed") from None
        try:
            values = yaml.safe_load(text)
        except yaml.YAMLError as problem:
            raise ValueError(f"{file}: {problem}") from None
    else:
        values = json.loads(text)
    if not isinstance(values, dict | None):
        raise ValueError(f"{file}: not a mapping of settings")
    return values or {}


def load_settings(file: str | None = None, overrides: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "FRAMELAKE_") -> tuple[Settings, list[Setting]]:
    """Defaults, then a JSON or YAML file, then environment variables, then overrides; each value with its source."""
    known = {f.name for f in dataclasses.fields(Settings)}
    layers: list[tuple[str, Mapping[str, object]]] = []
    if file:
        with open(file, encoding="utf-8") as held:
            layers.append((file, _parsed(file, held.read())))
    env = os.environ if environment is None else environment
    layers.append(("environment", {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix) and k[len(prefix) :].lower() in known}))
    layers.append(("override", {k: v for k, v in (overrides or {}).items() if v is not None}))
    values, sources = {}, {}
    for source, layer in layers:
        for name, value in layer.items():
            if name not in known:
                raise ValueError(f"unknown setting {name!r} in {source}")
            values[name], sources[name] = _coerced(name, value), source
    settings = Settings(**values)
    return settings, [Setting(f.name, getattr(settings, f.name), sources.get(f.name, "default")) for f in dataclasses.fields(Settings)]


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def suggestion(name: str, known: tuple[str, ...] = VARIABLES) -> str | None:
    """The first known name within two edits."""
    return next((k for k in known if edit_distance(name.lower(), k) <= 2), None)


def diagnose(settings: Settings) -> Diagnosis:
    """What is wrong with the settings, with hints for misspelt variables."""
    from framelake.operators.template import parse_template

    out = Diagnosis()
    if not settings.source:
        out.errors.append("source is empty")
    if not settings.destination:
        out.errors.append("destination is empty")
    elif not settings.destination.startswith("/"):
        out.errors.append("destination is not an absolute path")
    for part in parse_template(settings.destination):
        for link in getattr(part, "links", ()):
            if link.unknown:
                near = suggestion(link.name)
                out.errors.append(f"unknown variable {{{link.name}}}")
                if near:
                    out.hints.append(f"did you mean {{{near}}}?")
    names = [link.name for part in parse_template(settings.destination) for link in getattr(part, "links", ())]
    if settings.destination and not {"name", "namenoext", "filename"} & set(names):
        out.warnings.append("destination has no file name variable, so files will collide")
    if settings.min_date and settings.max_date and settings.min_date > settings.max_date:
        out.errors.append("min_date is after max_date")
    if "{number}" not in settings.duplicates_format:
        out.errors.append("duplicates_format lacks {number}")
    for name, allowed in (("granularity", GRANULARITIES), ("existing", ("number", "skip", "overwrite")), ("related", ("none", "strict", "loose")), ("duplicate_handling", ("none", "skip", "report"))):
        if getattr(settings, name) not in allowed:
            out.errors.append(f"{name} is none of {', '.join(allowed)}")
    if settings.companion_minutes is not None and settings.companion_minutes < 0:
        out.errors.append("companion_minutes is negative")
    return out


def settings_hash(settings: Settings) -> str:
    """SHA-256 over length-prefixed names and values, so no two settings share a writing."""
    text = "".join(f"{len(x)}:{x}" for f in dataclasses.fields(settings) for x in (f.name, repr(getattr(settings, f.name))))
    return hashlib.sha256(text.encode()).hexdigest()
