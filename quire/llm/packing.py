"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document (its ids, then a separator) gives as many full windows as it
fills; what remains of it, cut in two if it is long, goes to the next group of
remainders. A group holds a fixed number of tokens, whatever the size of the
table, and is dealt to windows by multiway differencing: the two partial
partitions with the largest spread are merged with opposing imbalances until
one is left. If its largest window is over capacity, the group is dealt again
to one window more.

A group is formed and packed inside the task that reads its documents: there is
no shuffle, and no task holds more than one group and one document.

Defined results: a null or empty text is the separator alone; repeated ids and
rows are packed each for itself; an empty table gives no piece. Sequence ids
are the task's number and a counter, so a task that runs again gives the same.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.tokens import encoder

WINDOW = 1024
#: Windows that a group of remainders fills.
GROUP_WINDOWS = 64
SEPARATOR = 0

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Deal item numbers to ``ways`` parts of near-equal sums by multiway differencing."""
    if not sizes:
        return [[] for _ in range(ways)]
    joined: list[tuple[int, int]] = []  # set number len(sizes) + k unites these two sets
    heap = []
    for item, size in enumerate(sizes):
        sums, sets = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], sets[0] = size, item
        heap.append((-size, item, sums, sets))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, sums, sets = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        sums, others = sums + more[::-1], others[::-1]
        both = np.flatnonzero((sets >= 0) & (others >= 0))
        merged = np.maximum(sets, others)
        if both.size:
            merged[both] = len(sizes) + len(joined) + np.arange(both.size)
            joined.extend(zip(sets[both].tolist(), others[both].tolist(), strict=True))
        order = np.argsort(-sums, kind="stable")
        sums, merged = sums[order], merged[order]
        sums = sums - sums[-1]  # only differences matter from here on
        heapq.heappush(heap, (-int(sums[0]), turn, sums, merged))
        turn += 1
    parts = []
    for root in heap[0][3].tolist():
        items, open_sets = [], [root] if root >= 0 else []
        while open_sets:
            one = open_sets.pop()
            if one < len(sizes):
                items.append(one)
            else:
                open_sets.extend(joined[one - len(sizes)])
        parts.append(sorted(items))
    return parts


def pack_group(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Parts of at most ``window`` tokens; the number of parts rises until they hold."""
    ways = max(1, -(-sum(sizes) // window))
    while True:
        parts = difference(sizes, ways)
        if max(sum(sizes[i] for i in part) for part in parts) <= window:
            return [part for part in parts if part]
        ways += 1


class _Packer:
    """Sequences of one task; ``rows`` collects its pieces."""

    def __init__(self, task: int, window: int):
        self.window, self.next_id = window, task << 40
        self.rows: list[tuple] = []
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, key, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        data = memoryview(ids.tobytes())
        while total - at >= self.window:
            self._place((key, at, self.window, zlib.crc32(data[4 * at : 4 * (at + self.window)]), total), self.next_id, 0)
            self.next_id += 1
            at += self.window
        half = self.window // 2
        while at < total:
            size = min(total - at, half)
            self.waiting.append((key, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), total))
            self.held += size
            at += size
        if self.held >= GROUP_WINDOWS * self.window - half // 2:
            self.flush()

    def flush(self) -> None:
        for part in pack_group([piece[2] for piece in self.waiting], self.window) if self.waiting else []:
            offset = 0
            for item in part:
                self._place(self.waiting[item], self.next_id, offset)
                offset += self.waiting[item][2]
            self.next_id += 1
        self.waiting, self.held = [], 0

    def _place(self, piece: tuple, sequence: int, offset: int) -> None:
        self.rows.append((*piece, sequence, offset))


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """One row for each piece of each document: where it is cut and where it lies."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId(), window)
        end = np.array([separator], "<u4")
        shape = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], shape), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            shape = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(key, np.concatenate([encode(text.as_py() or ""), end]))
                if len(packer.rows) > 20_000:
                    yield out()
        packer.flush()
        if packer.rows:
            yield out()

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, {PIECE}"
    ).withColumnRenamed("id", id_column)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op6_packing": op6_packing}
