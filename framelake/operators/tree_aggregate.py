"""Per-key results when a handful of keys hold most rows.

Spark's two-phase aggregate sends every map task's partial state of a key to one reducer: with a hundred
thousand map tasks a key that occurs everywhere gives that reducer a hundred thousand states. Here the
states travel up a tree instead. The leaves are the input chunks (one task's partition, whose size
``spark.sql.files.maxPartitionBytes`` or the advisory shuffle size fixes), combined where they are by the
map-side phase of the first round; every later round merges at most ``fan_in`` states of a key, so there
are ceil(log_fan_in(chunks)) rounds and no reducer ever receives more than ``fan_in`` states of one key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
_NODE = "_tree_node"


@dataclass(frozen=True)
class Merge:
    """A state made of rows by ``start`` and of states by ``merge`` (a function of the state column)."""

    start: Column
    merge: object

    @staticmethod
    def count() -> Merge:
        return Merge(F.count(F.lit(1)), F.sum)

    @staticmethod
    def sum(column: Column) -> Merge:
        return Merge(F.sum(column), F.sum)

    @staticmethod
    def min(column: Column) -> Merge:
        return Merge(F.min(column), F.min)

    @staticmethod
    def max(column: Column) -> Merge:
        return Merge(F.max(column), F.max)


def rounds_for(chunks: int, fan_in: int) -> int:
    """Merge rounds that bring ``chunks`` leaves to one root."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    left, rounds = max(1, chunks), 0
    while left > 1:
        left, rounds = math.ceil(left / fan_in), rounds + 1
    return max(1, rounds)


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    states: Mapping[str, Merge],
    chunks: int | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row for each distinct combination of ``keys`` with the merged ``states``.

    Null keys form a group of their own, as in GROUP BY. An empty input gives no rows. ``chunks`` is an
    upper bound of the input's partitions; where it isn't given it is the shuffle width, which holds for
    any input that comes out of a shuffle (give the number of splits for one that comes from a scan). More
    partitions than that only make the root's fan-in wider, never the result wrong. Columns of the input that are neither keys nor used by a state are not read, whatever
    their names.
    """
    if chunks is None:
        chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = rounds_for(chunks, fan_in)
    key_cols = [F.col(f"`{k}`") for k in keys]
    level = df.withColumn(_NODE, F.spark_partition_id() if rounds == 1 else F.floor(F.spark_partition_id() / fan_in))
    aggs = [s.start.alias(name) for name, s in states.items()]
    if rounds == 1:
        return level.groupBy(*key_cols).agg(*aggs)
    level = level.groupBy(*key_cols, F.col(_NODE)).agg(*aggs)
    for last in [False] * (rounds - 2) + [True]:
        merged = [s.merge(F.col(f"`{name}`")).alias(name) for name, s in states.items()]
        if last:
            return level.groupBy(*key_cols).agg(*merged)
        level = level.withColumn(_NODE, F.floor(F.col(_NODE) / fan_in)).groupBy(*key_cols, F.col(_NODE)).agg(*merged)
    return level


def latest_delivery(df: DataFrame, key: str, order: str, columns: Mapping[str, Column]) -> DataFrame:
    """One row for each non-null ``key``: its delivery with the greatest ``order`` (then greatest values).

    A max over a struct, so map tasks combine redeliveries before the shuffle, and the shuffle is spread
    over the keys, not over hot values. Rows without a key identify nothing and are left out.
    """
    packed = F.struct(F.col(f"`{order}`").alias("_o"), *[c.alias(n) for n, c in columns.items()])
    one = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(F.max(packed).alias("_row"))
    return one.select(key, *[F.col("_row").getField(n).alias(n) for n in columns])
