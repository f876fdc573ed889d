"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots. Every shard has a preference order over
all slots, a permutation made from two hashes of its name; shards take turns, and
each claims the first slot of its order that is still free, until none is left.
So shares differ by one slot at most, and few slots move when a shard comes or
goes. The table's size is a parameter, so it is broadcast; a row is placed in
constant time, by its key's hash modulo the table.

Defined results: a null key is placed as the empty one; equal keys have the same
shard, so repeated rows stay together; an empty table gives an empty table; other
columns are ignored by ``place`` and kept by ``write``, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import table, unused

SHARDS, SLOTS = 64, 8209


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards have distinct names, one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots are a prime number, no fewer than shards")
    at = [_hash(f"offset:{name}") % slots for name in shards]
    step = [_hash(f"skip:{name}") % (slots - 1) + 1 for name in shards]
    held, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while held[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            held[at[shard]] = shard
            free -= 1
            if not free:
                return held


def names(count: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(count)]


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key_column: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) of every row; no shuffle."""
    shape = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    filled = rows.sparkSession.createDataFrame(list(enumerate(fill(names(shards), slots))), shape)
    keyed = rows.select(F.col(key_column), slot_of(F.col(key_column), slots).alias("slot"))
    return keyed.join(F.broadcast(filled), "slot").select(key_column, "slot", "shard")  # as many rows as slots


def write(rows: DataFrame, path: str, key_column: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> str:
    """All rows and columns as Parquet, a folder for each shard; gives the name of the folders' column.

    That name is ``shard``, with underscores after it where the rows have such a
    column themselves. Rows are dealt out by shard; adaptive execution cuts a shard
    with very many rows, equal ones too, into several tasks and files.
    """
    slot, folder = unused(rows, "slot"), "shard"
    while folder in {c.lower() for c in rows.columns}:
        folder += "_"
    shape = T.StructType([T.StructField(slot, T.IntegerType()), T.StructField(folder, T.IntegerType())])
    filled = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(fill(names(shards), slots))), shape))
    placed = rows.withColumn(slot, slot_of(F.col(key_column), slots)).join(filled, slot).drop(slot)
    placed.hint("rebalance", folder).write.mode("errorifexists").partitionBy(folder).parquet(path)
    return folder


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return place(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}

ORACLE_SQL = {
    "op8_sharding": f"""
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST({fill(names(SHARDS), SLOTS)}[slot + 1] AS INTEGER) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
"""
}
