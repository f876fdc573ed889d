"""Broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcasting if it has no more rows than that.

    No more than these rows and one are counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame) -> DataFrame:
    """The table, marked to be joined by shuffle whatever its size: many small broadcasts add up on the driver."""
    return df.hint("merge")
