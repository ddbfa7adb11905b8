"""Validation of files with the reason of each rejection, and path safety."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A validator: its name, what makes a row fail (null counts as passing), and the reason then."""

    name: str
    fails: Column
    reason: Column


def glob_pattern(glob: str) -> str:
    """A Java regex: ``**/`` any folders, ``*`` and ``?`` within one name; without case."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return rf"(?i)\A{out}\z"


def relative_path(path: Column, root: str) -> Column:
    """The path under a root, compared without case; only the file name outside it."""
    base = root.rstrip("/") + "/"
    return F.when(F.lower(path).startswith(base.lower()), F.substring(path, len(base) + 1, 1 << 30)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def date_rules(ts: Column, min_date: datetime | None, max_date: datetime | None) -> list[Rule]:
    rules = []
    if max_date is not None:
        rules.append(Rule("MaxDate", ts > F.lit(max_date).cast("timestamp"), F.lit(f"after {max_date:%Y-%m-%d %H:%M:%S}")))
    if min_date is not None:
        rules.append(Rule("MinDate", ts < F.lit(min_date).cast("timestamp"), F.lit(f"before {min_date:%Y-%m-%d %H:%M:%S}")))
    return rules


def exclude_rule(path: Column, root: str, globs: Sequence[str]) -> Rule:
    """Fails with the first glob that matches the path under the root."""
    relative = relative_path(path, root)
    first = F.coalesce(*[F.when(relative.rlike(glob_pattern(g)), F.lit(g)) for g in globs], F.lit(None).cast("string")) if globs else F.lit(None).cast("string")
    return Rule("ExcludePattern", first.isNotNull(), F.concat(F.lit("matches "), first))


def first_failure(rules: Sequence[Rule]) -> Column:
    """``struct(rule, reason)`` of the first rule that fails; null for a valid row."""
    none = F.lit(None).cast("struct<rule:string,reason:string>")
    return F.coalesce(*[F.when(r.fails, F.struct(F.lit(r.name).alias("rule"), r.reason.alias("reason"))) for r in rules], none)


def all_failures(rules: Sequence[Rule]) -> Column:
    """The structs of every rule that fails, in the rules' order."""
    each = [F.when(r.fails, F.struct(F.lit(r.name).alias("rule"), r.reason.alias("reason"))) for r in rules]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<rule:string,reason:string>>")


def validated(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``is_valid`` and ``rejection`` (the first failure)."""
    return files.withColumn("rejection", first_failure(rules)).withColumn("is_valid", F.col("rejection").isNull())


def scan_totals(validated_files: DataFrame, size: str = "length") -> DataFrame:
    """One row: total, valid and skipped files, total bytes."""
    return validated_files.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("skipped"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_bytes")
    )


def within_depth(path: Column, root: str, max_depth: int | None) -> Column:
    """Whether a file lies at most ``max_depth`` folders deep, the root being 1; none and 0 don't limit."""
    if not max_depth or max_depth < 0:
        return F.lit(True)
    return F.size(F.split(relative_path(path, root), "/")) <= max_depth


def unknown_location(location: Column, reason: Column) -> Column:
    """Rows the unknown-files report is about: no location, and a reason other than None."""
    return location.isNull() & (reason != "None")


def safe_path(path: Column, root: str) -> Column:
    """Absolute, without ``..`` segments, and inside the root (without case)."""
    base = root.rstrip("/").lower()
    inside = (F.lower(path) == base) | F.lower(path).startswith(base + "/")
    return F.coalesce(path.startswith("/") & ~F.array_contains(F.split(path, r"[/\\]"), "..") & inside, F.lit(False))


def safe_input_path(path: Column) -> Column:
    """Absolute and without ``..`` segments; a name that merely contains two dots is fine."""
    return F.coalesce(path.startswith("/") & ~F.array_contains(F.split(path, r"[/\\]"), ".."), F.lit(False))


def destination_root(template: str) -> str:
    """The folder of a template's text before its first variable."""
    static = template.split("{", 1)[0]
    return static if "{" not in template else static.rpartition("/")[0] or "/"


def assert_safe(plan: DataFrame, column: str, root: str) -> DataFrame:
    """The plan, failing the query at the first row whose path isn't safe."""
    message = F.concat(F.lit("unsafe path: "), F.coalesce(F.col(column), F.lit("null")))
    return plan.withColumn(column, F.when(safe_path(F.col(column), root), F.col(column)).otherwise(F.raise_error(message)))
