"""Shards packed block by block against one walk over all units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import shards


def plain(chars, limit):
    """The bin of each unit, by the rule."""
    out, number, size, held = [], 0, 0, 0
    for some in chars:
        if held and size + some > limit:
            number, size, held = number + 1, 0, 0
        out.append(number)
        size, held = size + some, held + 1
        if size >= limit:
            number, size, held = number + 1, 0, 0
    return out


def sizes(rng, count, limit):
    return rng.choice([0, 0, 1, limit // 4, limit // 2, limit, limit + 7, *rng.integers(1, limit, 6)], count)


@pytest.mark.parametrize("seed", range(40))
def test_blocks_follow_one_another(seed):
    """Any cut into blocks gives the bins of the whole."""
    rng = np.random.default_rng(seed)
    limit = int(rng.choice([5, 20, 1000]))
    chars = sizes(rng, int(rng.integers(1, 200)), limit)
    cuts = sorted({0, len(chars), *rng.integers(0, len(chars) + 1, int(rng.integers(0, 9))).tolist()})
    size, number, found = shards.NOTHING, 0, []
    for begin, end in zip(cuts, cuts[1:]):
        found += shards.pack(chars[begin:end], size, number, limit).tolist()
        closed, size = shards.fold(chars[begin:end], limit).follow(size, limit)
        number += closed
    assert found == plain(chars.tolist(), limit)


def test_a_table_is_bounded_by_the_limit():
    block = shards.fold(np.ones(50_000, np.int64), 1000)
    assert len(block.sums) <= 1001 and block.follow(shards.NOTHING, 1000) == (50, shards.NOTHING) and block.follow(10, 1000) == (50, 10)


@pytest.mark.parametrize("block_units", [7, 1000])
def test_shards_of_many_blocks(spark, block_units):
    """Half of all units have one signature; others have few or one; no block holds a whole large one."""
    rng = np.random.default_rng(1)
    rows = [(k, "all" if k % 2 else f"s{k % 60}", int(c)) for k, c in enumerate(sizes(rng, 600, 1000))]
    frame = spark.createDataFrame(rows, "unit_id long, signature string, chars long")
    expected = {}
    for signature in {r[1] for r in rows}:
        own = sorted(r for r in rows if r[1] == signature)
        expected.update(zip((r[0] for r in own), plain([r[2] for r in own], 1000), strict=True))
    found = shards.shard_pack(frame.repartition(5), 1000, block_units).collect()
    assert len(found) == 600 and {r["unit_id"]: r["bin"] for r in found} == expected
    assert shards.shard_pack(frame.where("false"), 1000).collect() == []
    text = frame.select(F.col("unit_id").cast("string").alias("unit_id"), "signature", "chars")
    assert shards.shard_pack(text, 1000, block_units).schema["unit_id"].dataType.simpleString() == "string"
