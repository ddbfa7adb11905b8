"""Numbering rows within keys when one key may hold a third of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.storage import write_table


def spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, partitions: int | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``name``: the 1-based place of a row among those of equal ``keys``, by ``order`` (nulls first).

    Rows are range-partitioned by keys and order, so a large key is cut over many partitions; a row's rank
    is its rank in its partition plus the rows of its key in earlier ones, which are counted in a table of at
    most one row for each key and partition. ``order`` has to tell rows of a key apart for the ranks to be
    the same in every run. ``sums`` {new column: column} adds running totals in the same way; nulls count as 0.
    """
    pid, sums = "_rank_part", sums or {}
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = write_table(df.repartitionByRange(n, *keys, *order).withColumn(pid, F.spark_partition_id()), "ranked")
    counted = {name: F.lit(1)} | {k: F.coalesce(F.col(c), F.lit(0)) for k, c in sums.items()}
    held = cut.groupBy(pid, *keys).agg(*[F.sum(c).alias(f"_all_{k}") for k, c in counted.items()])
    earlier = W.partitionBy(*keys).orderBy(pid).rowsBetween(W.unboundedPreceding, -1)
    offsets = held.select(pid, *keys, *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in counted]).where(F.col(f"_before_{name}") > 0)
    upto = W.partitionBy(pid, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({f"_local_{k}": F.sum(c).over(upto) for k, c in counted.items()})
    l, o = local.alias("l"), offsets.alias("o")
    same = F.col(f"l.{pid}") == F.col(f"o.{pid}")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    total = lambda k: (F.col(f"l._local_{k}") + F.coalesce(F.col(f"o._before_{k}"), F.lit(0))).cast("bigint").alias(k)
    return l.join(o, same, "left").select(*[F.col(f"l.`{c}`") for c in df.columns], *[total(k) for k in counted])
