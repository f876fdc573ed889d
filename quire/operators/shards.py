"""Packing of units into shards as a parallel prefix.

Units of one signature fill bins in order, and a unit's bin depends on all units
before it, but only by the size of the bin that is open when it comes. So the order
is cut into blocks over all tasks, and a block is a function from the open size at
its beginning to the bins that it closes and the open size at its end. What a block
does with an open size is decided where the open bin closes; from there on it packs
as from nothing. Its function is therefore a table over the running sums up to the
limit, however many units it has. Open sizes go from block to block by these tables,
and every block is packed from its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.fixpoint import reliable
from quire.plans.sizes import small

SHARD_CHARS = 96_000
#: Units that a block holds, about.
BLOCK_UNITS = 1 << 16
#: The open size of a bin that holds nothing; one with units of no characters has 0.
NOTHING = -1


@dataclass
class Block:
    """What a run of units does with an open bin, by the sums of its first characters."""

    sums: np.ndarray  # distinct running sums up to the limit, and the first beyond
    onto: np.ndarray  # of the unit behind each: bins closed and open size at the end, if a bin closes with it
    before: np.ndarray  # the same, if one closes before the sum's first unit
    fresh: tuple[int, int]
    total: int

    def follow(self, size: int, limit: int) -> tuple[int, int]:
        """(bins closed, open size at the end) from an open size."""
        if size == NOTHING:
            return self.fresh
        room = limit - size
        at = int(np.searchsorted(self.sums, room))
        if at == len(self.sums):
            return 0, size + self.total
        closed, left = (self.onto if self.sums[at] == room else self.before)[at]
        return int(closed) + 1, int(left)


def _following(sums: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For a bin that begins with each unit: the unit that begins the next bin, and whether there is one."""
    units = np.arange(len(sums) - 1)
    met = np.searchsorted(sums, sums[:-1] + limit)
    closes = met < len(sums)
    exact = closes & (sums[np.minimum(met, len(sums) - 1)] == sums[:-1] + limit)
    return np.where(exact | (met - 1 == units), met, met - 1), closes


def fold(chars: np.ndarray, limit: int) -> Block:
    """The function of a run of units."""
    sums = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    then, closes = _following(sums, limit)
    bins, left = [0] * len(sums), [NOTHING] * len(sums)
    total = int(sums[-1])
    for unit in range(len(chars) - 1, -1, -1):  # from the end, so that what follows is known
        if closes[unit]:
            bins[unit], left[unit] = bins[then[unit]] + 1, left[then[unit]]
        else:
            left[unit] = total - int(sums[unit])
    outcome = np.array([bins, left], np.int64).T
    # a bin with room for r characters closes with the first unit whose sum is r, or before the one whose sum is over it
    reach, first = np.unique(sums[1:], return_index=True)
    upto = min(len(reach), int(np.searchsorted(reach, limit)) + 1)
    reach, first = reach[:upto], first[:upto]
    return Block(reach, outcome[first + 1], outcome[first], (int(outcome[0, 0]), int(outcome[0, 1])), total)


def pack(chars: np.ndarray, size: int, number: int, limit: int) -> np.ndarray:
    """The bin of each unit, from an open size and the open bin's number."""
    out = np.empty(len(chars), np.int64)
    held = size != NOTHING
    size = max(size, 0)
    for at, some in enumerate(chars.tolist()):
        if held and size + some > limit:
            number, size = number + 1, 0
        out[at] = number
        size, held = size + some, True
        if size >= limit:
            number, size, held = number + 1, 0, False
    return out


def _ordered(units: DataFrame, blocks: int) -> DataFrame:
    """Units in order of signature and id, with the number of their block, a range of that order."""
    dealt = units.select("signature", "unit_id", F.col("chars").cast("long").alias("chars")).repartitionByRange(blocks, "signature", "unit_id").sortWithinPartitions("signature", "unit_id")
    return dealt.withColumn("block", F.spark_partition_id())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """(signature, block, rows) of the runs of a partition's rows, one at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        signatures = np.asarray(batch.column("signature").to_pylist(), object)
        numbers = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((signatures[1:] != signatures[:-1]) | (numbers[1:] != numbers[:-1])) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            now = (signatures[begin], int(numbers[begin]))
            if now != key and held:
                yield *key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(begin, end - begin))
    if held:
        yield *key, pa.Table.from_batches(held)


_TABLE = "signature string, block int, sums binary, onto binary, before binary, bins long, left long, total long"


def shard_pack(units: DataFrame, limit: int = SHARD_CHARS, block_units: int = BLOCK_UNITS) -> DataFrame:
    """(unit_id, signature, bin): greedy bins of at most ``limit`` characters, in order of unit ids.

    A bin closes before a unit that would take it over the limit, and at once when it
    has reached it. No task holds more of a signature than one block.
    """
    if not 1000 <= limit <= 1_000_000:
        raise ValueError("limit is 1,000 to 1,000,000 characters")
    kind = units.schema["unit_id"].dataType.simpleString()
    units = reliable(units.select("signature", "unit_id", "chars"))  # read for their number, their ranges and themselves
    blocks = max(1, -(-units.count() // block_units))
    ordered = reliable(_ordered(units, blocks))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for signature, number, rows in _runs(batches):
            block = fold(rows.column("chars").to_numpy(), limit)
            columns = [[signature], [number], *[[x.astype("<i8").tobytes()] for x in (block.sums, block.onto, block.before)], [block.fresh[0]], [block.fresh[1]], [block.total]]
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["signature", "block", "sums", "onto", "before", "bins", "left", "total"])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The open size and bin at the beginning of each block; one table at a time."""
        key, size, number = None, NOTHING, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["signature"] != key:
                    key, size, number = row["signature"], NOTHING, 0
                out.append((key, row["block"], size, number))
                read = lambda name, row=row: np.frombuffer(row[name], "<i8")
                block = Block(read("sums"), read("onto").reshape(-1, 2), read("before").reshape(-1, 2), (row["bins"], row["left"]), row["total"])
                closed, size = block.follow(size, limit)
                number += closed
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["signature", "block", "size", "number"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _runs(batches):
            bins = pack(rows.column("chars").to_numpy(), rows.column("size")[0].as_py(), rows.column("number")[0].as_py(), limit)
            for batch in pa.table([rows.column("unit_id"), rows.column("signature"), pa.array(bins)], ["unit_id", "signature", "bin"]).to_batches(max_chunksize=10_000):
                yield batch

    tables = ordered.mapInArrow(folded, _TABLE)
    # a row for each block of a signature, so a signature of very many units is a short stream
    starts = tables.repartition("signature").sortWithinPartitions("signature", "block").mapInArrow(followed, "signature string, block int, size long, number long")
    joined = ordered.join(small(reliable(starts)), ["signature", "block"]).select("signature", "block", "unit_id", "chars", "size", "number")
    dealt = joined.repartition(F.col("signature"), F.col("block")).sortWithinPartitions("signature", "block", "unit_id")
    return dealt.mapInArrow(packed, f"unit_id {kind}, signature string, bin bigint")
