"""Connected components of an edge table by alternating star contraction.

Every round is two distributed joins over the edges; nothing is gathered or
broadcast, since tables of many rounds would add up on the driver, and a
vertex with very many neighbours is only ever a join key, which adaptive
execution splits. Rounds are cut with reliable checkpoints; their number grows
with the logarithm of the longest path. A round deals few edges from few tasks,
so what it writes follows the edges, not the square of the shuffle partitions.

Defined results: an edge with a null end links nothing; loops and repeated edges
add nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import reliable
from quire.plans.sizes import dealt

#: Edges that one task of a round holds at least, once there are more tasks than cores.
TASK_EDGES = 100_000


def _tasks(edges: DataFrame, rows: int) -> int:
    return max(edges.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_EDGES))


def _large_star(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each neighbour larger than a vertex is linked to the smallest vertex nearby."""
    tasks = tasks or _tasks(edges, 0)
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each neighbour smaller than a vertex, and the vertex, is linked to the smallest of them."""
    tasks = tasks or _tasks(edges, 0)
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(u, v): each vertex that isn't the smallest of its component, with that smallest one.

    ``edges`` has integer columns u and v, in any direction, repeated or not;
    loops are ignored. An empty table gives an empty table.
    """
    edges = reliable(edges.where("u <> v").select("u", "v").distinct())  # not true of a null
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            return edges
        tasks = _tasks(edges, mark[0])
        edges = reliable(_small_star(_large_star(edges.coalesce(tasks), tasks), tasks))
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges
    raise RuntimeError(f"components did not settle in {rounds} rounds")
