"""Links between texts whose five-word shingle sets resemble each other by 0.8 or more.

Resemblance is the share of distinct shingles that two texts have in common.
Texts of one shingle set are folded first. ``BANDS`` keys of ``ROWS`` minima each
bring candidates together: a pair at 0.8 misses all keys with a chance of 7e-5,
nearer pairs with less. Every link is then verified on the shingle sets
themselves (32-bit hashes), so none is below the bound.

A bucket is walked breadth first, which gives a spanning forest of its links. A
large bucket is dealt into chunks that each hold the bucket's first member too,
so rows grow with the members. Members that this leaves outside the component of
the first one are then compared with all others, chunk by chunk, so no pair of a
bucket is left out; buckets of one component need nothing more. Buckets of the
same members are walked once.

Words are cut and compared as in ``sketches``; a text of fewer words has one
shingle, a null or blank one none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import sketches
from quire.llm.common import partitions, reliable, slices
from quire.llm.graph import components
from quire.plans.sizes import dealt, small

LEAST = 0.8
BANDS, ROWS = 24, 5
#: Members, and shingles of members, that one chunk of a bucket holds.
CHUNK_ROWS = 1024
CHUNK_SHINGLES = 1 << 20
_ALL = 1 << 60
_RANDOM = np.random.default_rng(42)
_FLIPS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def _bands(shingles: np.ndarray) -> list[int]:
    """A signed key for each band, with the band's number in it."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, shingles.size, 2048):
        least = np.minimum(least, ((shingles[at : at + 2048, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(rows)]


def _shingles(text: str | None, hashes) -> tuple[np.ndarray, int]:
    """A text's distinct shingle hashes, and the name of the set."""
    found = sketches.sketch(text, hashes, _ALL)
    return found, (xxhash.xxh64_intdigest(found.tobytes()) or 1) if found.size else 0


def name(text_column: str) -> Column:
    """The name of a text's shingle set, as ``prints`` gives it."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = sketches._WordHashes()
        for texts in batches:
            yield pd.Series(np.array([_shingles(text, hashes)[1] for text in texts], np.uint64).view(np.int64))

    return F.pandas_udf(run, "bigint")(text_column)


def prints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", signature: Callable[[str | None], int] | None = None) -> DataFrame:
    """(id, fp, bands, shingles): fp names the shingle set, 0 the empty one; no shuffle.

    Given ``signature``, an unsigned number of a text, it is column ``sign``.
    Sets are given away a slice of texts at a time.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sketches._WordHashes()
        for batch in (some for whole in batches for some in slices(whole, 1)):
            fps, bands, sets, signs = [], [], [], []
            for text in batch.column(1):
                value = text.as_py()
                found, fp = _shingles(value, hashes)
                signs.append(signature(value) if signature else 0)
                fps.append(fp)
                bands.append(_bands(found) if found.size else [])
                sets.append(np.unique((found >> np.uint64(32)).astype("<u4")).tobytes())
            numbers = [pa.array(np.array(some, np.uint64).view(np.int64)) for some in (fps, signs)]
            columns = [batch.column(0), numbers[0], pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary()), numbers[1]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "bands", "shingles", "sign"])

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    made = texts.mapInArrow(run, f"id {kind}, fp bigint, bands array<bigint>, shingles binary, sign bigint")
    return made if signature else made.drop("sign")


def _forest(fps: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between distinct sets, breadth first."""
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([s.size for s in sets])
    own = np.split(flat, np.cumsum(sizes)[:-1])
    rest, rest_flat, held = np.arange(fps.size), flat, np.zeros(values.size, bool)
    left, right, queue = [], [], []
    while rest.size:
        if not queue:
            queue, rest, rest_flat = [rest[0]], rest[1:], rest_flat[sizes[rest[0]] :]
            continue
        one = queue.pop()
        held[own[one]] = True
        starts = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
        both = np.add.reduceat(held[rest_flat], starts, dtype=np.int64)
        held[own[one]] = False
        near = both >= least * (sizes[one] + sizes[rest] - both) - 1e-9
        if near.any():
            found = rest[near]
            left += [int(fps[one])] * found.size
            right += fps[found].tolist()
            queue.extend(found)
            rest_flat = rest_flat[np.repeat(~near, sizes[rest])]
            rest = rest[~near]
    return left, right


def _walk(rows: DataFrame, least: float) -> DataFrame:
    """(u, v) of each chunk; ``rows`` has key, i, j, fp and shingles."""

    def edges(members: dict[int, bytes]) -> pa.RecordBatch:
        u, v = _forest(np.array(list(members), np.int64), [np.frombuffer(s, "<u4") for s in members.values()], least)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = {}, None
        for batch in batches:
            key, i, j, fps = (batch.column(k).to_pylist() for k in range(4))
            for *this, fp, shingles in zip(key, i, j, fps, batch.column(4), strict=True):
                if this != name:
                    if len(held) > 1:
                        yield edges(held)
                    held, name = {}, this
                if fp not in held:
                    held[fp] = shingles.as_py()
        if len(held) > 1:
            yield edges(held)

    spread = rows.select("key", "i", "j", "fp", "shingles").repartition(partitions(rows), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return spread.mapInArrow(run, "u bigint, v bigint")


def _chunks(members, shingles):
    return F.greatest(F.ceil(members / CHUNK_ROWS), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")


def links(found: DataFrame, distinct: DataFrame, least: float = LEAST, groups: DataFrame | None = None) -> DataFrame:
    """(u, v): links between fps that connect all texts that resemble each other.

    ``found`` is what ``prints`` gives, ``distinct`` has fp, bands and size. ``groups``
    (fp, key) are candidates found in other ways: those of one key are a bucket, too.
    """
    keyed = distinct.select("fp", "size", F.explode("bands").alias("key"))
    if groups is not None:
        keyed = keyed.unionByName(groups.join(dealt(distinct.select("fp", "size").where("size > 0")), "fp").select("fp", "size", "key"))
    buckets = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("fp").alias("leader"), F.bit_xor(F.xxhash64("fp")).alias("members"))
        .where("n > 1")
        .groupBy("n", "all", "leader", "members")
        .agg(F.min("key").alias("key"))
        .select("key", "leader", _chunks(F.col("n"), F.col("all")).alias("chunks"))
    )
    # few buckets are told to all tasks, so keys that meet nothing aren't dealt out again
    met = reliable(keyed.join(small(reliable(buckets)), "key").select("key", "fp", "size", "leader", "chunks"))
    large = met.where("chunks > 1")
    several = not large.isEmpty()
    # rows of one fp have one set, so copies are folded where they are read and sets are dealt out once
    sets = found.groupBy("fp").agg(F.first("shingles").alias("shingles")).join(dealt(met.select("fp").distinct()), "fp", "left_semi")
    sets = reliable(sets) if several else sets

    own = met.select("key", F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("i"), "fp")
    first = met.where("fp = leader").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), "fp")
    edges = reliable(_walk(own.unionByName(first).withColumn("j", F.lit(0)).join(sets, "fp"), least))

    if not several:
        return edges
    label = components(edges).select(F.col("u").alias("__fp"), F.col("v").alias("label"))
    named = large.join(label, F.col("fp") == F.col("__fp"), "left").select("key", "fp", "size", "leader", F.coalesce("label", "fp").alias("label"))
    tops = named.where("fp = leader").select("key", F.col("label").alias("top"))
    named = reliable(named.join(tops, "key").select("key", "fp", "size", (F.col("label") == F.col("top")).alias("main")))
    parts = [F.sum(F.when(side, x).otherwise(0)) for side in (F.col("main"), ~F.col("main")) for x in (F.lit(1), F.col("size"))]
    counts = named.groupBy("key").agg(_chunks(*parts[:2]).alias("m"), _chunks(*parts[2:]).alias("r")).where("r > 0")
    spread = F.xxhash64("fp", F.lit(1))
    block = F.when(F.col("main"), F.pmod(spread, "m")).otherwise(F.col("m") + F.pmod(spread, "r")).cast("int")
    begin = F.when(F.col("main"), F.col("m")).otherwise(0)
    other = F.explode(F.sequence(begin, F.col("m") + F.col("r") - 1))
    pairs = named.join(counts, "key").select("key", "fp", block.alias("block"), other.alias("other"))
    pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    return edges.unionByName(_walk(pairs.join(sets, "fp"), least))
