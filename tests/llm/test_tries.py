"""The trie of conversations against writing out every prefix."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import tries

SHAPE = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain_conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, plain_digest(role or "", text or ""), role or "", text or ""))
    return {conv: [t[3:] for t in sorted(turns)] for conv, turns in out.items()}


def plain_rebuilt(known):
    out = {}
    for conv, turns in known.items():
        base = conv - int(conv - 20 * int(conv / 20))  # the remainder has the sign of conv
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = known.get(base, [])[:h] + turns[h:]
    return out


def plain_nodes(known):
    members, ended = {}, {}
    for conv, turns in known.items():
        ended.setdefault(tuple(turns), []).append(conv)
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += node not in children
            saved[node[:depth]] += (len(convs) - 1) * words
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children.get(node, 0), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ended.get(node, [])))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[7]))


def nodes(spark, rows, rebuilt=True):
    listed = tries.conversations(spark.createDataFrame(rows, SHAPE).select("*", *[F.lit(1).alias(c) for c in ("unit", "units", "path", "key", "n", "low", "base", "h")]))
    return order(rows_of(tries.trie(tries.paths(tries.rebuilt(listed) if rebuilt else listed))))


def made(seed, convs, words=4, turns=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(-30, convs):
        for turn in range(rng.randint(1, turns)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randint(0, words))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [1, 200, 1 << 23])
def test_nodes(spark, monkeypatch, size):
    """Over one range and over very many, in which most nodes lie on edges."""
    monkeypatch.setattr(tries, "RANGE_BYTES", size)
    monkeypatch.setattr(tries, "BATCH", 7)
    monkeypatch.setattr(tries, "BLOCK_TEXT", 40)
    rows = made(3, 150 if size == 1 else 300)
    assert nodes(spark, rows) == order(plain_nodes(plain_rebuilt(plain_conversations(rows))))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, None, "", ""), (2, 5, "user", "a  b\tc\x0b d"), (2, 5, "assistant", "x"), (None, 1, "user", "lost"),
        (40, 0, "user", "long " * 300_000), (41, 0, "user", "long " * 300_000), (43, 9, "u", "1:ab"), (44, 9, "u1", ":ab"), (25, 1, "user", "no base"), (26, 1, "user", "no base"),
    ]
    known = plain_conversations(rows)
    assert nodes(spark, rows) == order(plain_nodes(plain_rebuilt(known)))
    assert nodes(spark, rows, rebuilt=False) == order(plain_nodes(known))


def test_empty(spark):
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "user", "x")]) == []


def test_a_path_of_very_many_members(spark, monkeypatch):
    """Its ids go over many ranges and blocks, and its nodes are on no more rows than others'."""
    monkeypatch.setattr(tries, "BLOCK_TEXT", 100)
    rows = [(k, t, "user", f"t{t}") for k in range(0, 2000) for t in range(2)] + [(k, 0, "user", f"other {k}") for k in range(2000, 2600)]
    assert nodes(spark, rows, rebuilt=False) == order(plain_nodes(plain_conversations(rows)))


def test_a_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 2500 else f"{c} {t}") for c in (7, 3) for t in range(3000)]
    known = plain_conversations(rows)
    found = nodes(spark, rows, rebuilt=False)
    assert len(found) == 1 + 2500 + 2 * 500
    assert found[0][:6] == (3, 0, None, 2, 1, 2) and found[0][6] == 2 * 2500
    assert {r[7] for r in found if r[1] == 3000} == {hashlib.sha256(str(c).encode()).hexdigest() for c in known}


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 16])
def test_loser_tree(runs):
    rng = random.Random(runs)
    turn = lambda: bytes([rng.randint(0, 2)]) * tries.UNIT
    sorted_runs, everything = [], []
    for k in range(runs):
        some = sorted(b"".join(turn() for _ in range(rng.randint(0, 5))) for _ in range(rng.choice([0, 1, 30])))
        everything += some
        sorted_runs.append([(path, tries.shared(some[j - 1], path) if j else 0, k) for j, path in enumerate(some)])
    merged = list(tries.LoserTree([iter(run) for run in sorted_runs]))
    assert [row[0] for row in merged] == sorted(everything)
    before = b""
    for path, lcp, _ in merged:
        assert lcp == tries.shared(before, path)
        before = path


def test_merging_compares_shared_turns_once(monkeypatch):
    """Paths that share many turns are told apart by LCPs; what is looked at grows with what is new."""
    looked, plain = [0], tries.shared

    def counted(a, b, least=0):
        found = plain(a, b, least)
        looked[0] += found - least + 1
        return found

    monkeypatch.setattr(tries, "shared", counted)
    head = b"".join(k.to_bytes(tries.UNIT, "big") for k in range(500))
    runs = []
    for run in range(8):
        some = [head + (8 * k + run).to_bytes(tries.UNIT, "big") for k in range(100)]
        runs.append(iter([(path, 500 if k else 0) for k, path in enumerate(some)]))
    assert len(list(tries.LoserTree(runs))) == 800
    assert looked[0] < 7 * 501 + 800 * 3 + 100
