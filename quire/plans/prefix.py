"""Running sums over a whole table without one task that orders it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_RANGES = 10_000


def range_of(df: DataFrame, key: str, ranges: int):
    """A column with the number of the range that a numeric key falls into, ascending."""
    ranges = max(1, min(MOST_RANGES, ranges))
    cuts = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(cuts).bit_length())),
        F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")),
        lambda state, _: _closer(state, bounds, F.col(key)),
        lambda state: state["low"],
    )
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(found)


def _closer(state, bounds, key):
    """One step of a binary search for the number of bounds below the key."""
    middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
    more = state["low"] < state["high"]
    above = F.element_at(bounds, F.least(middle + 1, F.size(bounds))) < key
    return F.struct(
        F.when(more & above, middle + 1).otherwise(state["low"]).alias("low"), F.when(more & ~above, middle).otherwise(state["high"]).alias("high")
    )


def running_sum(df: DataFrame, key: str, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """The rows with the sum of ``value`` up to and with each row, in order of ``key``.

    Sums of key ranges come first (one row a range), then sums inside each range,
    so windows hold one range. Rows with equal keys count together.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__range", range_of(df, key, ranges))
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("__range", before.alias("__before")))  # at most MOST_RANGES rows
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(key))
    return dealt.join(starts, "__range").withColumn(name, F.col("__before") + inside).drop("__range", "__before")
