"""Joins against dimensions whose size is checked before one is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows a dimension may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 10_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join facts with a dimension that has one row for each key.

    A dimension of at most ``broadcast_rows`` rows is broadcast, whatever the skew of the facts. A larger one
    is shuffled, and adaptive execution cuts the partitions of facts that a hot key makes too large (the
    dimension's side of a cut partition is read by each part). Null keys match nothing; with ``how='left'``
    their facts stay.
    """
    return facts.join(F.broadcast(dim) if is_small(dim, broadcast_rows) else dim, list(on), how)
