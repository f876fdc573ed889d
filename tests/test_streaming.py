"""States of review logs: a stream, however it is cut, against the whole log."""

import random

import pytest

from quire.streaming import states

SHAPE = "event_id string, seq long, key string, action string, prior_event_id string, evidence_revision string"


def log(seed, size=120):
    """Proposals and what closes them, over a few keys; some proposals stay open, some events repeat."""
    rng, rows, open_ = random.Random(seed), [], []
    for seq in range(size):
        if open_ and rng.random() < 0.5:
            prior, key = open_.pop(rng.randrange(len(open_)))
            rows.append((f"e{seq}", seq, key, rng.choice(["accept", "reject"]), prior, rng.choice(["r1", "r2", None])))
        else:
            key = f"k{rng.randrange(6)}"
            rows.append((f"e{seq}", seq, key, "propose", None, rng.choice(["r1", "r2"])))
            open_.append((f"e{seq}", key))
    return rows


@pytest.mark.parametrize(("seed", "parts", "ordered"), [(1, 1, True), (2, 5, True), (3, 7, False)])
def test_any_cut_of_a_log_gives_its_states(spark, tmp_path, seed, parts, ordered):
    rows = log(seed)
    rng = random.Random(seed)
    told = list(rows) if ordered else rng.sample(rows, len(rows))  # later events may come first, and some come twice
    told += rng.sample(rows, 9)
    for part in range(parts):
        spark.createDataFrame(told[part::parts] if not ordered else told[len(told) * part // parts : len(told) * (part + 1) // parts], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in/part{part}")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = states.follow(stream, "r1", f"{tmp_path}/out", f"{tmp_path}/ck")
    query.processAllAvailable()
    query.stop()
    plain = lambda df: sorted(tuple(r[c] for c in ("key", "seq", "event_id", "action", "stale", "pending", "stale_pending")) for r in df.collect())
    expected = plain(states.states_of(spark.createDataFrame(rows, SHAPE), "r1"))
    assert plain(states.latest(spark, f"{tmp_path}/out")) == expected
    assert len(expected) == 6 and any(r[5] or r[4] for r in expected)
