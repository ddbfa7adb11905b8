"""Counts and total length per country and per city of located files, and the keys that hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.lookup import lookup_join
from framelake.operators.tree_aggregate import FAN_IN, Merge, latest_delivery, tree_aggregate
from framelake.storage import write_table

HOT_SHARE = 0.02


def _clean(column):
    """Trimmed of blanks and lower-cased; null where nothing is left."""
    text = F.lower(F.trim(column))
    return F.when(text != "", text)


def country_codes(boundaries: DataFrame) -> DataFrame:
    """One row for each lower-case spelling of a country, its code or its name: ``spelling``, ``code``.

    A spelling that is one country's code and another's name means the code; a name of two countries means
    the smaller code.
    """
    codes = boundaries.select(_clean(F.col("country")).alias("spelling"), F.trim("country").alias("code"), F.lit(0).alias("rank"))
    names = boundaries.select(_clean(F.col("name")).alias("spelling"), F.trim("country").alias("code"), F.lit(1).alias("rank"))
    return (
        codes.unionByName(names)
        .where(F.col("spelling").isNotNull() & F.col("code").isNotNull())
        .groupBy("spelling")
        .agg(F.min(F.struct("rank", "code")).alias("m"))
        .select("spelling", F.col("m.code").alias("code"))
    )


def key_totals(files: DataFrame, boundaries: DataFrame, fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """``key_kind, country, city, files, total_length`` for every country and every (country, city).

    Each file_id counts once, by its latest delivery (seen_at, null first; among equals the greatest
    values). A country is known by its code or name in ``boundaries``, trimmed and without case; a country
    that is neither keeps its own upper-case spelling as code, so no file is lost. Blank and null countries
    do not count, nor blank and null cities in the city rows. A null length adds 0. Rows without file_id
    are left out. Empty tables give no rows.
    """
    once = latest_delivery(
        files,
        "file_id",
        "seen_at",
        {"spelling": _clean(F.col("location.country")), "city": _clean(F.col("location.city")), "length": F.coalesce(F.col("length"), F.lit(0)).cast("bigint")},
    )
    located = once.where(F.col("spelling").isNotNull())
    # The aggregation runs over spellings; codes are looked up on its small result and merged once more.
    states = {"files": Merge.count(), "total_length": Merge.sum(F.col("length"))}
    by_spelling = tree_aggregate(located, ["spelling", "city"], states, chunks, fan_in)
    coded = lookup_join(by_spelling, country_codes(boundaries), ["spelling"]).select(
        F.coalesce("code", F.upper("spelling")).alias("country"), "city", "files", "total_length"
    )
    again = {n: Merge(F.sum(n), F.sum) for n in states}
    by_city = write_table(tree_aggregate(coded, ["country", "city"], again, chunks, fan_in), "city-totals")
    by_country = tree_aggregate(by_city, ["country"], again, chunks, fan_in)
    return by_country.select(F.lit("country").alias("key_kind"), "country", F.lit("").alias("city"), "files", "total_length").unionByName(
        by_city.where(F.col("city").isNotNull()).select(F.lit("city").alias("key_kind"), "country", "city", "files", "total_length")
    )


def hot_keys(totals: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """The rows of :func:`key_totals` with at least ``share`` of their kind's files: ``key_kind, country, city``."""
    whole = totals.groupBy("key_kind").agg(F.sum("files").alias("whole"))  # two rows
    return totals.join(F.broadcast(whole), "key_kind").where(F.col("files") >= F.lit(share) * F.col("whole")).select("key_kind", "country", "city")
