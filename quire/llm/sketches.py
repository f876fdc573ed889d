"""Bottom-k sketches of word shingles.

A document's fingerprint keeps the ``k`` smallest distinct 64-bit hashes of its
five-word shingles. Sketches merge: the k smallest of a union are among the k
smallest of its parts. Two sketches estimate resemblance and containment, one
the number of distinct shingles; below k shingles all of these are exact.

Words are cut at white space and compared without regard to case. A text of
fewer than five words has one shingle, the whole of it; an empty or null text
has none. Two empty sketches resemble each other fully, an empty and another
one not at all.

``with_edits`` pairs every document with the next one in descending id order
(after the last comes the first). Rows are dealt into ranges of ids, a task for
each, and sorted inside them; each range also gets the first document of the
range below it, so no task depends on another and no order over all rows runs in
one task. An id that fills more than one range by itself (null ids may) is dealt
evenly, by the rows' places in the table, to as many ranges as it fills.

Defined results: equal ids are ordered by text, those of an id with ranges of its
own by place in the table, which has to be the same whenever it is read, as a
stored table's is; null ids come last; repeated rows each count; a table of one
row is its own next; an empty table gives an empty table; ids that aren't whole
numbers are an error. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import partitions, table, word_windows

SHINGLE_WORDS = 5
K = 128
#: Text that one range of ids should hold, in code points.
RANGE_CHARS = 32 << 20
MOST_RANGES = 20_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NULL_ID = -(1 << 63)


class _WordHashes(dict):
    """Hashes of words, kept until there are too many."""

    limit = 1 << 16

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def _smallest(values: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, sorted."""
    if values.size > 8 * k:
        near = np.unique(np.partition(values, 4 * k)[: 4 * k])
        if near.size >= k:
            return near[:k]
    return np.unique(values)[:k]


def sketch(text: str | None, hashes: _WordHashes, k: int = K, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The k smallest distinct shingle hashes of a text (uint64, sorted)."""
    kept = np.empty(0, np.uint64)
    for words in word_windows((text or "").lower(), width):
        values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        reach = min(width, len(words))
        total = np.zeros(len(words) - reach + 1, np.uint64)
        for step in range(reach):
            total = total * _MULTIPLIER + values[step : len(words) - reach + 1 + step]
        kept = _smallest(np.concatenate([kept, _mix(total + np.uint64(reach))]), k)
    return kept


def encode(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8").astype(np.uint64)


def merge(*parts: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def distinct_count(values: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    if values.size < k:
        return float(values.size)
    return (k - 1) / ((float(values[-1]) + 1.0) / 2.0**64)


def _union_shares(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    union = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.isin(both, union, assume_unique=True).sum()), union.size


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index of the shingle sets."""
    if not a.size and not b.size:
        return 1.0
    shared, size = _union_shares(a, b, k)
    return shared / size


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not a.size:
        return 1.0
    if a.size < k and b.size < k:
        return np.intersect1d(a, b, assume_unique=True).size / a.size
    shared, size = _union_shares(a, b, k)
    return min(1.0, shared / size * distinct_count(merge(a, b, k=k), k) / distinct_count(a, k))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _ranges(docs: DataFrame) -> list[int]:
    """The keys that bound the ranges, ascending; a key that fills several ranges is there several times."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    wanted = min(MOST_RANGES, max(partitions(docs), -(-chars // RANGE_CHARS)))
    cuts = docs.approxQuantile("key", [(i + 1) / wanted for i in range(wanted - 1)], 1 / (4 * wanted)) if wanted > 1 else []
    return sorted(int(c) for c in cuts)


def _spread(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """The rows with ``range``, counting upwards in descending order of keys, and ``place``, their order among equal keys.

    A range holds the keys from one bound up to the next. A key that is several
    bounds has as many ranges of its own, after the range of the keys above it.
    """
    times = Counter(cuts)
    bounds = sorted(times)
    if not bounds:
        return docs.withColumn("range", F.lit(0)).withColumn("place", F.lit(0).cast("long"))
    first, own, count = {}, {}, 0  # numbers of the range above each bound, and of the bound's own ranges
    for bound in reversed(bounds):
        first[bound], count = count, count + 1
        if times[bound] > 1:
            own[bound], count = count, count + times[bound]
    listed = F.array(*[F.lit(c) for c in bounds])
    below = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(bounds).bit_length())),
        F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda s, _: _halve(s, listed),
        lambda s: s["lo"],
    )
    numbers = F.array(F.lit(count), *[F.lit(first[bound]) for bound in bounds])
    plain = F.element_at(numbers, below + 1)
    if not own:
        return docs.withColumn("range", plain.cast("int")).withColumn("place", F.lit(0).cast("long"))
    starts = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    sizes = F.create_map(*[F.lit(x) for bound in own for x in (bound, times[bound])])
    docs = docs.withColumn("place", F.when(F.col("key").isin(list(own)), F.monotonically_increasing_id()).otherwise(0))
    many = F.element_at(starts, F.col("key")) + F.pmod(F.col("place"), F.element_at(sizes, F.col("key")))
    return docs.withColumn("range", F.coalesce(many, plain).cast("int"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, id, text), each range in descending order and its guest last."""
    hashes = _WordHashes()
    rows: list[tuple] = []
    last = None  # (range, id, text, sketch) that waits for the next document

    def finish(one, text: str, own: np.ndarray) -> None:
        _, key, mine, print_ = one
        changed = edited(mine, text)
        other = sketch(changed, hashes)
        rows.append(
            (
                key,
                len(mine),
                hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                encode(print_),
                encode(other),
                resemblance(print_, other),
                resemblance(print_, own),
                distinct_count(print_),
                containment(print_, other),
            )
        )

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "kept_in_edited"]
    shape = None

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        made = pa.RecordBatch.from_arrays(
            [pa.array(columns[0], shape), pa.array(columns[1], pa.int64()), *[pa.array(c) for c in columns[2:5]], *[pa.array(c, pa.float64()) for c in columns[5:]]],
            names,
        )
        rows.clear()
        return made

    for batch in batches:
        shape = batch.column(2).type
        for at, guest, key, value in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), strict=True):
            text = value.as_py() or ""
            print_ = sketch(text, hashes)
            if last is not None and last[0] == at:
                finish(last, text, print_)
            last = None if guest else (at, key, text, print_)
            if len(rows) >= 1000:
                yield out()
    if rows:
        yield out()


def with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, the shingles of the document and how many the edit keeps."""
    if not isinstance(docs.schema[id_column].dataType, T.IntegralType):
        raise TypeError("documents are ordered by ids that are whole numbers")
    kind = docs.schema[id_column].dataType.simpleString()
    docs = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(_NULL_ID)).alias("key"),
    )
    dealt = _spread(docs, _ranges(docs))
    # a row for each range: its first document, and the range that this document follows; the very first follows the very last
    heads = dealt.groupBy("range").agg(F.min(F.struct(F.bitwise_not("key").alias("down"), "place")).alias("head")).orderBy("range").collect() or [(0, (0, 0))]  # bounded by MOST_RANGES
    hosts = [(~down, place, at, heads[k - 1][0]) for k, (at, (down, place)) in enumerate(heads)]
    found = docs.sparkSession.createDataFrame(hosts, "__key long, __place long, __range int, host int")
    guests = (
        dealt.join(F.broadcast(found), (F.col("key") == F.col("__key")) & (F.col("place") == F.col("__place")) & (F.col("range") == F.col("__range")))
        .groupBy("host")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast(kind).alias("id"), "text", F.lit(_NULL_ID).alias("key"), F.col("host").alias("range"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("guest"))
    )
    rows = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    rows = rows.repartitionById(heads[-1][0] + 1, F.col("range")).sortWithinPartitions("range", "guest", F.desc("key"), "place", "text")
    return rows.select("range", "guest", "id", "text").mapInArrow(
        _pairs,
        f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "distinct_shingles double, kept_in_edited double",
    ).withColumnRenamed("id", id_column)


def _halve(state, bounds):
    """One step of a binary search for the number of bounds below or equal to the key."""
    middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
    open_ = state["lo"] < state["hi"]
    up = F.element_at(bounds, F.least(middle + 1, F.size(bounds))) <= F.col("key")
    return F.struct(
        F.when(open_ & up, middle + 1).otherwise(state["lo"]).alias("lo"),
        F.when(open_ & ~up, middle).otherwise(state["hi"]).alias("hi"),
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every document and its edited text."""
    return with_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
