"""Destinations that no two files share."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import base_name, dir_name, file_extension, file_stem
from framelake.operators.ranking import spread_rank
from framelake.session import ship_package
from framelake.storage import write_table

MOST_NUMBERS = 10_000


def numbered(path: str, number: int, form: str) -> str:
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    if not dot:
        stem, ext = name, ""
    return f"{folder}/" * ("/" in path) + stem + form.replace("{number}", str(number)) + dot + ext


def resolve_collisions(plan: DataFrame, existing: DataFrame | None = None, order: str = "path", column: str = "destination", form: str = "-{number}", mode: str = "number") -> DataFrame:
    """Adds ``resolved``: the destination each row gets, in the order of ``order`` (which tells rows apart).

    Without case, the first row that asks for a destination keeps it; later ones get the first number from 1
    whose name is neither claimed nor in ``existing`` (a frame with the same column). ``mode`` ``skip`` drops
    them instead (null), ``overwrite`` lets all keep it. Numbers are ranks; only families of names (same
    folder, extension and stem without numbers) in which a numbered name meets an asked-for or existing one
    are replayed one row after the other. A row that needs a number over MOST_NUMBERS fails the query with its name,
    whichever way its number is found.
    """
    if mode == "overwrite":
        return plan.withColumn("resolved", F.col(column))
    key, rank = "_claim", "_rank"
    keyed = plan.withColumn(key, F.lower(F.col(column)))
    taken = (existing.select(F.lower(F.col(column)).alias(key)).distinct() if existing is not None else plan.sparkSession.createDataFrame([], f"{key} string")).withColumn("_taken", F.lit(1))
    ranked = spread_rank(keyed, [key], [order], rank).join(taken, key, "left")
    number = F.col(rank) - 1 + F.coalesce(F.col("_taken"), F.lit(0))
    if mode == "skip":
        return ranked.withColumn("resolved", F.when(number == 0, F.col(column))).drop(key, rank, "_taken")
    name, folder = base_name(F.col(column)), dir_name(F.col(column))
    suffix = F.concat(F.lit(form.split("{number}")[0]), number.cast("string"), F.lit(form.split("{number}")[1]))
    made = F.concat(folder, F.lit("/"), file_stem(name), suffix, file_extension(name))
    made = F.when(number > MOST_NUMBERS, F.raise_error(F.concat(F.lit("no free name for "), F.col(column)))).otherwise(made)
    pattern = "(" + re.escape(form).replace(r"\{number\}", r"\d+") + ")+$"
    family = F.lower(F.concat_ws("\x00", folder, F.regexp_replace(file_stem(name), pattern, ""), file_extension(name)))
    first = write_table(ranked.withColumns({"resolved": F.when(number == 0, F.col(column)).otherwise(made), "_number": number, "_family": family}), "claims")
    # A clash: a numbered name that someone asks for, or that exists.
    asked = first.select(F.lower(F.col(column)).alias("_name")).distinct().unionByName(taken.select(F.col(key).alias("_name")))
    clashes = first.where("_number > 0").select(F.lower("resolved").alias("_name"), "_family").join(asked, "_name", "left_semi").select("_family").distinct()
    clean = first.join(clashes, "_family", "left_anti")
    dirty = first.join(clashes, "_family", "left_semi")
    stock = taken.select(F.col(key).alias("_name"))
    own = F.lower(F.concat_ws("\x00", dir_name(F.col("_name")), F.regexp_replace(file_stem(base_name(F.col("_name"))), pattern, ""), file_extension(base_name(F.col("_name")))))
    stock = stock.withColumn("_family", own).join(clashes, "_family", "left_semi")

    def replay(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        claimed = set(held["_name"])
        out, reached = [], {}  # names are only ever taken, so a wish goes on from the number it reached last
        for wish in (rows := rows.sort_values(order, kind="stable"))[column]:
            n = reached.get(wish.lower(), 0)
            got = numbered(wish, n, form) if n else wish
            while got.lower() in claimed:
                n += 1
                if n > MOST_NUMBERS:
                    raise ValueError(f"no free name for {wish}")
                got = numbered(wish, n, form)
            claimed.add(got.lower())
            reached[wish.lower()] = n
            out.append(got)
        return rows.assign(resolved=out)[list(rows.columns)]

    ship_package(plan.sparkSession)
    replayed = dirty.groupBy("_family").cogroup(stock.groupBy("_family")).applyInPandas(replay, dirty.schema)
    return clean.unionByName(replayed).drop(key, rank, "_taken", "_number", "_family")
