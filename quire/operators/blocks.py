"""A published search index: postings in blocks by cells of unit numbers, and top-k search by bounds.

Units are numbered in order of their membership, so that each membership (the units
that the same scopes see) begins a cell of ``CELL`` numbers and a cell belongs to
one membership only. A block has the postings of one term in one cell, with their
number and their greatest count. A scope is a few memberships, so its blocks are
found by a join with these; what the scope's frequencies need is in the blocks'
heads, which are read without the postings.

Blocks of different terms meet by their cell. The greatest counts of a cell's blocks
bound the score of every unit in it: the cells with the greatest bounds are scored
first, and of the others only those whose bound reaches the worst score of the best
``limit`` so far. Counts and weights aren't negative, and scores and bounds are the
same sums of products in the same order, so a bound is never below a score.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.search import query_terms
from quire.plans.fixpoint import reliable
from quire.plans.sizes import small

_WORD = re.compile(r"\w+")
#: Numbers of a cell, so no block has more postings.
CELL = 1024
#: Folders that terms are dealt to by hash; a search opens those of its terms.
BUCKETS = 64
#: Cells whose blocks share a file of a bucket.
CELLS_A_FILE = 1 << 16
#: Rows of an Arrow batch of blocks.
ROWS = 10_000
#: Cells that are scored first.
FIRST_CELLS = 16
#: Heads of blocks, four numbers each, that a search looks at by itself.
MOST_HEADS = 20_000


def numbered(units: DataFrame) -> DataFrame:
    """(unit_id, membership, shard) with ``unit_no``: ascending by membership, shard and id, a new cell for each membership.

    Numbers are places in a range-sorted table: places inside a partition are
    known there, and the rows that tell how many units of a membership come before
    a partition are one for each partition and membership in it.
    """
    keys = ("membership", "shard", "unit_id")
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.select("unit_id", "membership", "shard").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = reliable(dealt.withColumn("place", F.monotonically_increasing_id()))  # partition, and place inside it
    placed = placed.withColumn("part", F.shiftright("place", 33))
    counts = reliable(placed.groupBy("membership", "part").agg(F.count("*").alias("n"), F.min("place").alias("least")))
    sizes = counts.groupBy("membership").agg(F.sum("n").alias("units"))
    starts = running(sizes.withColumn("span", F.ceil(F.col("units") / CELL) * CELL), [], "membership", "span", "start")
    before = running(counts, ["membership"], "part", "n", "earlier")
    at = before.join(starts.select("membership", "start"), "membership").select("membership", "part", (F.col("start") + F.col("earlier") - F.col("least")).alias("shift"))
    return placed.join(small(at), ["membership", "part"]).select("unit_id", "membership", "shard", (F.col("place") + F.col("shift")).alias("unit_no"))


def running(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The sum of ``value`` of the rows before, for tables of a row a partition or membership."""
    from pyspark.sql import Window

    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


_BLOCK = "term string, cell long, membership string, n int, most int, places array<short>, counts array<int>"


def _blocks_of(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Blocks of units in order of their numbers, one cell of ``span`` numbers at a time; a cell that lies in two partitions has blocks in both."""
    names = ["term", "cell", "membership", "n", "most", "places", "counts"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.list_(pa.int32())]
    held: dict[str, tuple[array, array]] = {}
    key = None

    def given() -> Iterator[pa.RecordBatch]:
        while held:
            rows = []
            for term in list(itertools.islice(held, ROWS)):
                places, counts = held.pop(term)
                rows.append((term, *key, len(places), max(counts), places, counts))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        # texts become Python strings one at a time, not a batch of thousands at once
        for number, membership, text in zip(*[batch.column(c) for c in ("unit_no", "membership", "text")], strict=True):
            membership = membership.as_py()
            cell, place = divmod(number.as_py(), span)
            if key != (cell, membership):
                if key is not None:
                    yield from given()
                key = cell, membership
            folded: Counter = Counter()
            for word, count in Counter(_WORD.findall(text.as_py() or "")).items():
                folded[word.casefold()] += count
            for term, count in folded.items():
                places, counts = held.get(term) or held.setdefault(term, (array("h"), array("i")))
                places.append(place)
                counts.append(count)
    if key is not None:
        yield from given()


def postings(units: DataFrame) -> DataFrame:
    """Blocks (term, cell, membership, n, most, places, counts) of (unit_no, membership, text), in order of numbers in each partition.

    ``places`` are numbers inside the cell, ascending, ``counts`` go with them. A
    text's words are counted in an Arrow function, since rows for single words cost
    several times as much as all the rest; no row is shuffled before it is a block.
    """
    span = CELL  # as it is here, where units are numbered by it; an executor has a module of its own
    return units.select("unit_no", "membership", "text").mapInArrow(lambda batches: _blocks_of(batches, span), _BLOCK)


def write(units: DataFrame, folder: str) -> None:
    """The blocks in a folder for each bucket, in files sorted by term and cell; a bucket of very many cells is several files."""
    blocks = postings(units).withColumn("bucket", bucket(F.col("term")))
    dealt = blocks.repartition(F.col("bucket"), F.floor(F.col("cell") / CELLS_A_FILE)).sortWithinPartitions("bucket", "term", "cell")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def open_blocks(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """The blocks of the terms, from their folders alone."""
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    shape = "term string, cell long, membership string, n int, most int, places array<short>, counts array<int>, bucket int"
    return spark.read.schema(shape).parquet(folder).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def _scores(columns: list[Column], weights: list[float], digits: int | None) -> Column:
    score = sum((column * F.lit(weight) for column, weight in zip(columns, weights, strict=True)), F.lit(0.0))
    return F.round(score, digits) if digits is not None else score


def _within(number: Column, cells: list[int], span: int) -> Column:
    """Whether a number lies in one of a few cells, as ranges that a scan's statistics can hold."""
    return functools.reduce(operator.or_, [(number >= c * span) & (number < (c + 1) * span) for c in cells])


def _scored(blocks: DataFrame, terms: list[str], order: list[int], weights: list[float], digits: int | None) -> DataFrame:
    """(unit_no, score) of the units in the blocks that hold all terms."""
    rows = blocks.select("term", (F.col("cell") * CELL).alias("begin"), F.explode(F.arrays_zip("places", "counts")).alias("p"))
    rows = rows.select("term", (F.col("begin") + F.col("p.places")).alias("unit_no"), "p.counts")
    counts = [F.max(F.when(F.col("term") == t, F.col("counts"))).alias(f"tf{k}") for k, t in enumerate(terms)]
    held = rows.groupBy("unit_no").agg(*counts).dropna(subset=[f"tf{k}" for k in range(len(terms))])
    return held.select("unit_no", _scores([F.col(f"tf{k}") for k in order], weights, digits).alias("score"))


def _bounds(blocks: DataFrame, terms: list[str], order: list[int], units: int, digits: int | None) -> tuple[list[float], list[int], object] | None:
    """(weights, the cells with the greatest bounds, what gives the cells that may reach a score), by the blocks' heads.

    Up to ``MOST_HEADS`` heads are looked at here; more are aggregated where they are.
    """
    heads, every = blocks.select("term", "cell", "n", "most"), range(len(terms))
    few = heads.limit(MOST_HEADS + 1).collect()
    if len(few) <= MOST_HEADS:
        frequency = [sum(row["n"] for row in few if row["term"] == t) for t in terms]
        if not all(frequency):
            return None
        weights = [math.log((units + 1) / (frequency[k] + 1)) for k in order]
        counts: dict[int, dict[str, int]] = {}
        for row in few:
            own = counts.setdefault(row["cell"], {})
            own[row["term"]] = max(row["most"], own.get(row["term"], 0))
        bounds = {cell: sum(counts[cell][terms[k]] * w for k, w in zip(order, weights, strict=True)) for cell in counts if len(counts[cell]) == len(terms)}
        ranked = sorted(bounds, key=lambda cell: (-bounds[cell], cell))
        spare = 0 if digits is None else 10.0**-digits  # what rounding may add to a score
        return weights, ranked[:FIRST_CELLS], lambda least: [c for c in ranked[FIRST_CELLS:] if least is None or bounds[c] + spare >= least]
    of = lambda column, t: F.max(F.when(F.col("term") == t, F.col(column)))
    cells = reliable(heads.groupBy("cell").agg(*[F.sum(F.when(F.col("term") == t, F.col("n"))).alias(f"n{k}") for k, t in enumerate(terms)], *[of("most", t).alias(f"tf{k}") for k, t in enumerate(terms)]))
    frequency = cells.agg(*[F.sum(f"n{k}") for k in every]).first()
    if not all(frequency):
        return None
    weights = [math.log((units + 1) / (frequency[k] + 1)) for k in order]
    bounded = cells.dropna(subset=[f"tf{k}" for k in every]).select("cell", _scores([F.col(f"tf{k}") for k in order], weights, digits).alias("bound"))
    chosen = [row["cell"] for row in bounded.orderBy(F.desc("bound"), "cell").limit(FIRST_CELLS).collect()]
    rest = bounded.where(~F.col("cell").isin(chosen))
    return weights, chosen, lambda least: (rest.where(F.col("bound") >= least) if least is not None else rest).select("cell")


def best(blocks: DataFrame, numbers: DataFrame, seen: list[str] | DataFrame, units: int, query: str, limit: int, digits: int | None = None) -> list:
    """(unit_no, unit_id, membership, score) of the best units of a scope, as rows; none where no unit can hold all terms.

    ``numbers`` has unit_no, unit_id and membership, ``seen`` is the memberships of the
    scope, by name if they are few, ``units`` is how many units these have. The score
    sums count * ln((N + 1) / (df + 1)) over the query's terms, repeats included; ids
    decide between equal ones.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    order = [terms.index(t) for t in query_terms(query)]
    blocks = blocks.where(F.col("membership").isin(seen)) if isinstance(seen, list) else blocks.join(small(seen), "membership", "left_semi")
    found = _bounds(blocks, terms, order, units, digits)
    if found is None or not found[1]:
        return []
    weights, chosen, reaching = found

    def top(some: DataFrame, names: DataFrame) -> list:
        scored = _scored(some, terms, order, weights, digits)
        rows = names.join(scored, "unit_no").select("unit_no", "unit_id", "membership", "score")
        return rows.orderBy(F.desc("score"), "unit_id").limit(limit).collect()  # limit rows at most

    inside = lambda cells: (blocks.where(F.col("cell").isin(cells)), numbers.where(_within(F.col("unit_no"), cells, CELL)))
    first = top(*inside(chosen))
    rest = reaching(first[-1]["score"] if len(first) == limit else None)
    if isinstance(rest, list):
        if not rest:
            return first
        if len(rest) <= FIRST_CELLS:
            return top(*inside(chosen + rest))
        rest = blocks.sparkSession.createDataFrame([(c,) for c in rest], "cell long")
    elif rest.isEmpty():
        return first
    both = rest.unionByName(blocks.sparkSession.createDataFrame([(c,) for c in chosen], "cell long"))
    return top(blocks.join(small(both), "cell", "left_semi"), numbers)
