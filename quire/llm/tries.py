"""Prefix trie of conversations by an LCP-aware external mergesort.

A turn becomes a unit of fixed width, a digest of role and text and its number of
words, where it is read, so texts are never shuffled, and a conversation is the
string of its units, its path. Equal paths are folded by partial aggregation. The
distinct ones are then sorted:

1. **Runs.** Each partition is sorted, and every path carries its LCP with the one
   before it, counted in turns. Runs are a checkpoint in the shared folder.
2. **Merge.** Ranges of paths, sized by bytes, get their slice of every run. A loser
   tree over the slices keeps, with each loser, its LCP with the path that beat it;
   two paths whose LCPs with the last winner differ are ordered by these alone, and
   others are compared from there on, so shared turns aren't compared again.
3. **Nodes.** The merged stream runs over a stack of open nodes. A path closes all
   nodes below its LCP with the one before, and these are finished.

A range can't finish the nodes on its first and last path, since its neighbours may
hold more of their members. It gives both paths with what it knows of each node on
them, and one last merge, of two paths a range, finishes those in the same way; its
size goes with the number of ranges and the length of conversations, not with rows.

The digest over the ids of a path's members is one SHA-256, which has no parallel
form. Ids are sorted over all tasks by ranges of (path, id); a path inside one range
is hashed there, and of those that a range begins or ends with its text goes on in
blocks, so a path that a third of all conversations share is one stream of
blocks to the hash and never a group in memory.

A conversation's path is one value of 20 bytes a turn, so a single conversation has
to stay below some 100 million turns, and a task holds one range of
``RANGE_BYTES`` or its longest path.

Defined results: null role or text counts as empty; turns are in order of their
number, null first, equal numbers in order of their digest, repeated rows being
turns each; turns of a null conversation belong to none and are left out; a table
without conversations has no nodes, not even a root; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import partitions, reliable, table

#: Bytes of a turn's digest, and of the turn with its number of words behind it.
DIGEST, UNIT = 16, 20
#: Bytes of paths (and of what goes with them) that a range of the merge holds.
RANGE_BYTES = 8 << 20
#: Code points of joined ids that a block has at least, but for the last.
BLOCK_TEXT = 1 << 20
#: Rows of an Arrow batch that is given.
BATCH = 4096

ROOT = bytes(DIGEST)


# ---------------------------------------------------------------- paths


def unit(role: Column, text: Column) -> Column:
    """A turn as hexadecimal digits of its digest and its number of words."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(F.sha2(named, 256), 1, 2 * DIGEST), F.lpad(F.lower(F.hex(words)), 2 * (UNIT - DIGEST), "0"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, units) of (conv_id, turn, role, text): the units of each conversation in order."""
    read = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", unit(F.col("role"), F.col("text")).alias("unit"))
    return read.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "unit"))), lambda t: t["unit"]).alias("units"))


def paths(listed: DataFrame) -> DataFrame:
    """(conv_id, path) of (conv_id, units)."""
    return listed.select("conv_id", F.unhex(F.array_join("units", "")).alias("path"))


# ---------------------------------------------------------------- members that end at a path


def ends(known: DataFrame) -> DataFrame:
    """(key, ends) of (key, conv_id): SHA-256 of each key's ids, ascending, comma-joined."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups inside the partition as digests, the first and the last one as blocks of text."""
        out = _Rows(["key", "first", "block", "ends"], [pa.binary(), pa.int64(), pa.string(), pa.string()])
        key, ids, size, first_group, given = None, [], 0, True, False
        for batch in batches:
            for now, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != key:
                    if key is not None:
                        if ids and (first_group or given):
                            yield from out.add(key, ids[0], ",".join(map(str, ids)), None)
                        elif ids:
                            yield from out.add(key, None, None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                        first_group = False
                    key, ids, size, given = now, [], 0, False
                ids.append(conv)
                size += 12
                if size > BLOCK_TEXT:  # goes on over blocks, wherever the group lies
                    yield from out.add(key, ids[0], ",".join(map(str, ids)), None)
                    ids, size, given = [], 0, True
        if key is not None and ids:
            yield from out.add(key, ids[0], ",".join(map(str, ids)), None)
        yield from out.rest()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(["key", "ends"], [pa.binary(), pa.string()])
        key, digest = None, None
        for batch in batches:
            for now, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now == key:
                    digest.update(b"," + block.encode())
                    continue
                if key is not None:
                    yield from out.add(key, digest.hexdigest())
                key, digest = now, hashlib.sha256(block.encode())
        if key is not None:
            yield from out.add(key, digest.hexdigest())
        yield from out.rest()

    dealt = known.select("key", "conv_id").repartitionByRange(partitions(known), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = reliable(dealt.mapInArrow(joined, "key binary, first long, block string, ends string"))
    whole = parts.where("ends IS NOT NULL").select("key", "ends")
    blocks = parts.where("ends IS NULL").select("key", "first", "block")
    chain = blocks.repartition("key").sortWithinPartitions("key", "first").select("key", "block").mapInArrow(chained, "key binary, ends string")
    return whole.unionByName(chain)


class _Rows:
    """Rows gathered into Arrow batches."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.rows = names, kinds, []

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= BATCH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(values, kind) for values, kind in zip(zip(*self.rows, strict=True), self.kinds, strict=True)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, self.names)


# ---------------------------------------------------------------- runs and their merge


def shared(a: bytes, b: bytes, least: int = 0) -> int:
    """The number of turns in which two paths agree at their beginning, ``least`` of them known."""
    most = min(len(a), len(b)) // UNIT
    while least < most and a[least * UNIT : (least + 1) * UNIT] == b[least * UNIT : (least + 1) * UNIT]:
        least += 1
    return least


class LoserTree:
    """Merges sorted runs of (path, LCP with the path before, ...) into one.

    Every head has its LCP with the last path that was given. Of two heads the one
    that shares more with it comes first, and their own LCP is the smaller of both;
    only where they share as much are the paths compared, from there on. A loser
    keeps its LCP with the winner, and meets the next one that has come by the same
    way, which is what it has to be compared with.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(run) for run in runs]
        self.ways = 1 << max(0, len(self.runs) - 1).bit_length()
        self.heads = [next(run, None) for run in self.runs] + [None] * (self.ways - len(self.runs))
        self.losers = [(-1, 0)] * self.ways  # (run, LCP with the winner) by inner node, the root at 1
        self.winner = self._play(1)

    def _play(self, node: int) -> tuple[int, int]:
        if node >= self.ways:
            return node - self.ways, 0  # nothing was given yet, which shares no turn
        return self._meet(node, self._play(2 * node), self._play(2 * node + 1))

    def _meet(self, node: int, one: tuple[int, int], other: tuple[int, int]) -> tuple[int, int]:
        """The winner of both; the loser stays at the node."""
        (a, with_a), (b, with_b) = one, other
        first, second = self.heads[a], self.heads[b]
        if second is None or first is not None and with_a > with_b:
            won, lost = one, other
        elif first is None or with_b > with_a:
            won, lost = other, one
        else:
            both = shared(first[0], second[0], with_a)
            won, lost = (one, (b, both)) if first[0] <= second[0] else (other, (a, both))
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        """Rows in order of paths, each with the LCP with the one before it."""
        while (head := self.heads[self.winner[0]]) is not None:
            run, lcp = self.winner
            yield head[0], lcp, *head[2:]
            self.heads[run] = following = next(self.runs[run], None)
            now, node = (run, following[1] if following else 0), (run + self.ways) // 2
            while node:
                now = self._meet(node, now, self.losers[node])
                node //= 2
            self.winner = now


# ---------------------------------------------------------------- nodes


class Open:
    """A node whose members may not all have come yet."""

    __slots__ = ("children", "depth", "edge", "ends", "key", "leaves", "low", "n", "parent", "saved", "waiting", "words")

    def __init__(self, parent: Open | None, unit: bytes, edge: bool):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0
        self.words = int.from_bytes(unit[DIGEST:], "big")
        self.edge = edge  # lies on the first path, so members may come before
        self.key = hashlib.sha256(parent.key + unit).digest()[:DIGEST] if parent else ROOT
        self.n = self.children = self.leaves = self.saved = 0
        self.low = self.ends = None
        self.waiting: list[tuple] = []  # rows of finished children, which lack this node's smallest member

    def take(self, n: int, low: int | None, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = self.ends or ends
        if low is not None and (self.low is None or low < self.low):
            self.low = low

    def finish(self) -> Iterator[tuple]:
        """Count the node and hand it to its parent; rows that are complete by now."""
        if not self.children:
            self.leaves = 1
        self.saved += (self.n - 1) * self.words
        for row in self.waiting:
            yield row._replace(parent_conv_id=self.low)
        row = Node(self.key, self.low, self.depth, None, None, self.n, self.children, self.leaves, self.saved, self.ends)
        if self.parent is None:
            yield row
            return
        self.parent.take(0, None, 1, self.leaves, self.saved)
        if self.parent.edge:
            yield row._replace(parent_key=self.parent.key)
        else:
            self.parent.waiting.append(row)


class Node(NamedTuple):
    """A finished node; of a parent that lies on an edge the key is told instead of its smallest member."""

    key: bytes
    conv_id: int
    depth: int
    parent_conv_id: int | None
    parent_key: bytes | None
    n_convs: int
    n_children: int
    n_leaves: int
    saved_tokens: int
    ends: str | None


def walk(merged: Iterator[tuple[bytes, int, list[tuple]]], edges: list[tuple[bytes, list[Open]]] | None = None) -> Iterator[Node]:
    """Finished nodes of paths in order.

    A path comes with its LCP with the one before and, by depth, what each of its
    nodes takes. With ``edges``, nodes on the first and the last path aren't
    finished; both paths are put there, with their nodes by depth, and on the last
    one None for those that the first has too.
    """
    stack: list[Open] = []
    first: tuple[bytes, list[Open]] | None = None
    path = b""
    for path, lcp, taken in merged:
        for node in reversed(stack[lcp + 1 :]):
            if not node.edge:
                yield from node.finish()
        del stack[lcp + 1 :]
        for depth in range(len(stack), len(path) // UNIT + 1):
            above = stack[-1] if stack else None
            stack.append(Open(above, path[(depth - 1) * UNIT : depth * UNIT] if above else b"", edges is not None and first is None))
        if first is None:
            first = path, list(stack)
        for node, facts in zip(stack, taken, strict=False):
            node.take(*facts)
    if edges is None:
        for node in reversed(stack):
            yield from node.finish()
    elif first:
        edges.append(first)
        if path != first[0]:
            edges.append((path, [None if node.edge else node for node in stack]))
        for node in stack:
            if not node.edge:
                yield from (row._replace(parent_key=node.key) for row in node.waiting)


_NODE = list(Node._fields)
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_EDGE = ["path", "n", "low", "children", "leaves", "saved", "path_ends"]
_EDGE_KINDS = [pa.binary(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string())]
_SQL = "key binary, conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_EDGE_SQL = "path binary, n array<long>, low array<long>, children array<long>, leaves array<long>, saved array<long>, path_ends array<string>"


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its slices of the runs merged, finished nodes and the two paths at its ends."""
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for run, lcp, path, n, low, digest in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            runs.setdefault(run, []).append((path, lcp, n, low, digest))
    slices = [runs[run] for run in sorted(runs)]
    for some in slices:
        some[0] = (some[0][0], 0, *some[0][2:])  # the path before it is in another range

    def facts() -> Iterator[tuple]:
        for path, lcp, n, low, digest in LoserTree([iter(some) for some in slices]):
            yield path, lcp, [(n, low)] * (len(path) // UNIT) + [(n, low, 0, 0, 0, digest)]

    edges: list[tuple[bytes, list[Open]]] = []
    out = _Rows(_NODE + _EDGE, _KINDS + _EDGE_KINDS)
    for row in walk(facts(), edges):
        yield from out.add(*row, *[None] * len(_EDGE))
    nothing = Open(None, b"", False)
    for path, nodes in edges:
        nodes = [node or nothing for node in nodes]
        of = [[getattr(node, name) for node in nodes] for name in ("n", "low", "children", "leaves", "saved", "ends")]
        yield from out.add(*[None] * len(_NODE), path, *of)
    yield from out.rest()


def _edges_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last merge, over the paths at the ends of all ranges in order."""

    def facts() -> Iterator[tuple]:
        before = None
        for batch in batches:
            for path, *known in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                yield path, shared(before, path) if before is not None else 0, list(zip(*known, strict=True))
                before = path

    out = _Rows(_NODE, _KINDS)
    for row in walk(facts()):
        yield from out.add(*row)
    yield from out.rest()


def _with_lcps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition as a run: its number, places in it, and LCPs with the path before."""
    from pyspark import TaskContext

    run, before, place = TaskContext.get().partitionId(), b"", 0
    for batch in batches:
        rows = batch.column("path").to_pylist()
        lcps = []
        for path in rows:
            lcps.append(shared(before, path))
            before = path
        size = len(rows)
        columns = [pa.array([run] * size, pa.int32()), pa.array(range(place, place + size), pa.int64()), pa.array(lcps, pa.int64()), *[batch.column(c) for c in ("path", "n", "low", "ends")]]
        yield pa.RecordBatch.from_arrays(columns, ["run", "place", "lcp", "path", "n", "low", "ends"])
        place += size


def trie(known: DataFrame) -> DataFrame:
    """The nodes of (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    known = reliable(known.select("conv_id", "path", F.unhex(F.sha2("path", 256)).alias("key")))
    folded = known.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first("key").alias("key"))
    named = folded.join(ends(known), "key").select("path", "n", "low", "ends")
    runs = reliable(named.sortWithinPartitions("path").mapInArrow(_with_lcps, "run int, place long, lcp long, path binary, n long, low long, ends string"))
    size = runs.agg(F.sum(F.length("path") + 160)).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES), partitions(known) if size > RANGE_BYTES // 8 else 1)
    dealt = runs.repartitionByRange(ranges, "path").sortWithinPartitions("run", "place").select("run", "lcp", "path", "n", "low", "ends")
    found = reliable(dealt.mapInArrow(_ranged, f"{_SQL}, {_EDGE_SQL}"))
    last = found.where("path IS NOT NULL").select(*_EDGE).repartition(1).sortWithinPartitions("path")  # two rows a range
    edges = reliable(last.mapInArrow(_edges_merged, _SQL))
    inside = found.where("path IS NULL").select(*_NODE)
    parents = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("edge_conv_id"))
    told = inside.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "edge_conv_id"))
    both = told.select(*_NODE).unionByName(edges.select(*_NODE))
    return both.select(*_NODE[1:4], *_NODE[5:9], F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


# ---------------------------------------------------------------- the query


def rebuilt(listed: DataFrame) -> DataFrame:
    """(conv_id, units) with the first turns taken from another conversation.

    A conversation c has the first h turns of c - c%20, all if there are fewer, then
    its own behind its first h, h being crc32 of the decimal c, modulo 4. No more than
    20 conversations on a side of zero share a beginning, so no join key is hot.
    """
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = listed.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("units", 1, 3).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = listed.select("conv_id", "units", base.alias("base"), taken.alias("h")).join(heads, "base", "left")
    before = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(before, F.slice("units", F.col("h") + 1, F.size("units"))).alias("units"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(paths(rebuilt(conversations(table(spark, sf_dir, "conversations")))))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}

_DUCK_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c) + 1), lambda i: ascii(substr(c, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, k: xor(r >> 1, 3988292384::BIGINT * (r & 1))))"""

# The SQL writes every prefix of every conversation out and counts groups of equal ones.
ORACLE_SQL = {
    "op13_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body,
         substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, {2 * DIGEST}) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, digest, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM turns
), ids AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS c FROM placed GROUP BY conv_id
), wanted AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295::BIGINT, {_DUCK_CRC}) % 4 AS h FROM ids
), mixed AS (
  SELECT w.conv_id, p.place, p.digest, p.words FROM wanted w JOIN placed p ON p.conv_id = w.base AND p.place <= w.h
  UNION ALL
  SELECT w.conv_id, p.place, p.digest, p.words FROM wanted w JOIN placed p ON p.conv_id = w.conv_id AND p.place > w.h
), numbered AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM mixed
), rows AS (
  SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS prefix FROM numbered
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT prefix, CAST(any_value(depth) AS BIGINT) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM rows GROUP BY prefix
), lasts AS (
  SELECT prefix, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM rows GROUP BY conv_id) GROUP BY prefix
), tree AS (
  SELECT n.*, p.conv_id AS parent_conv_id, count(k.prefix) AS n_children
  FROM nodes n
  LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = substr(n.prefix, 1, length(n.prefix) - {2 * DIGEST})
  LEFT JOIN nodes k ON k.depth = n.depth + 1 AND substr(k.prefix, 1, length(k.prefix) - {2 * DIGEST}) = n.prefix
  GROUP BY ALL
), sums AS (
  SELECT above, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT n_children, n_convs, words, unnest(list_transform(range(0, depth + 1), lambda d: substr(prefix, 1, d * {2 * DIGEST}))) AS above FROM tree)
  GROUP BY above
)
SELECT t.conv_id, t.depth, t.parent_conv_id, CAST(t.n_convs AS BIGINT) AS n_convs, CAST(t.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(l.ends_sha256, sha256('')) AS ends_sha256
FROM tree t JOIN sums s ON s.above = t.prefix LEFT JOIN lasts l ON l.prefix = t.prefix
"""
}
